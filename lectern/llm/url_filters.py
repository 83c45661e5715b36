"""URL filters: a Bloom filter cascade over the corpus's own key universe.

Keys are ``host`` (a blocked host with its subdomains) or ``host/path`` (a rule
on a host, its subdomains and paths with that prefix). Every URL can only ask
for a few keys: the suffixes of its host with as many labels as some listed key
has, followed by the prefixes of its path as long as some listed path. The
distinct keys that a corpus asks for are its universe. Level 1 encodes the
listed keys, level 2 the universe's keys that level 1 lets through wrongly, level 3
the listed keys that level 2 lets through, and so on until no error is
left, so that membership is exact for every key of the universe, without a join.

Level 1's error rate follows the sizes of list and universe, so that about as
many false keys pass as there are listed keys: what the driver gathers, and the
filters that are broadcast, are bounded by the list, which is a parameter. Both
sizes are checked.

Nulls: a null URL, or one without ``://``, has an empty host and path, matches
no rule and is allowed. Repeated rows are judged one by one; an empty table
gives an empty result. Other columns of the input are passed through untouched by
:func:`judge_urls`, whose own columns are named by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the production run.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Hosts blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: False keys that the driver gathers at most, for each listed key, and at least.
FALSE_PER_KEY, FALSE_LEAST = 8, 1024


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Bloom:
    """Bits for keys given as two 64-bit hashes each."""

    def __init__(self, keys: np.ndarray, rate: float, salt: int):
        self.salt = np.uint64(salt)
        self.n_hashes = max(1, round(-math.log2(rate)))
        self.n_bits = max(64, math.ceil(len(keys) * self.n_hashes / math.log(2)))
        self.bits = np.zeros(self.n_bits, bool)
        for at in self._places(keys):
            self.bits[at] = True

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        from .common import mix

        a, b = mix(keys[:, 0] + self.salt), mix(keys[:, 1] ^ self.salt) | np.uint64(1)
        for i in range(self.n_hashes):
            yield ((a + np.uint64(i) * b) % np.uint64(self.n_bits)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= self.bits[at]
        return out


def cascade_holds(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """A key belongs to the list if the number of levels it passes in a row is odd."""
    passed, going = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for level in levels:
        going = going & level.holds(keys)
        passed += going
    return passed % 2 == 1


def _hash_columns(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit("second"))]


def _as_pairs(rows) -> np.ndarray:
    return np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2).astype(np.uint64)


def build_cascade(universe: DataFrame, listed: list[str]) -> list[Bloom]:
    """universe: distinct keys with hashes h1 and h2, as many as the corpus has; listed: the keys to hold."""
    spark = universe.sparkSession
    held = spark.createDataFrame([(k,) for k in listed], "key string").select(*_hash_columns(F.col("key"))).collect()
    inside = np.unique(_as_pairs(held), axis=0)
    n_universe = universe.count()
    most = max(FALSE_LEAST, FALSE_PER_KEY * len(inside))
    rate = min(0.5, math.sqrt(0.5) * len(inside) / max(1, n_universe))
    while True:
        first = Bloom(inside, rate, 1)
        sent = spark.sparkContext.broadcast((first, inside))

        @F.pandas_udf("boolean")
        def passes_wrongly(h1: pd.Series, h2: pd.Series) -> pd.Series:
            level, own = sent.value
            keys = np.column_stack([h1.to_numpy(np.int64), h2.to_numpy(np.int64)]).astype(np.uint64)
            known = {tuple(x) for x in own.tolist()}
            out = level.holds(keys)
            out[out] = [tuple(x) not in known for x in keys[out].tolist()]
            return pd.Series(out)

        wrong = universe.where(passes_wrongly("h1", "h2")).select("h1", "h2").limit(most + 1).collect()
        if len(wrong) <= most:
            break
        rate /= 16
    levels, other = [first], _as_pairs(wrong)
    # From here on both sets are at most as large as the list: the driver finishes the cascade.
    mine, salt = inside, 2
    while len(other):
        level = Bloom(other, 0.5, salt)
        levels.append(level)
        mine, other, salt = other, mine[level.holds(mine)], salt + 1
    return levels


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, blocked_hosts=BLOCKED_HOSTS, host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """df with host, path, the longest fitting rule (or null) and the verdict.

    A rule fits its host and all subdomains where the URL's path starts with the
    rule's. Of the fitting ones the longest wins; where no rule fits, URLs of a
    blocked host are blocked and others allowed.
    """
    rule_keys = [k for _, k in rules]
    listed = sorted({*rule_keys, *blocked_hosts})
    shapes = sorted({(k.split("/", 1)[0].count(".") + 1, len(k) - len(k.split("/", 1)[0])) for k in listed}, reverse=True)
    clash = {host, path, rule, verdict} & ({*df.columns} - {url})
    df = df.drop(*clash)
    parsed = df.withColumns({host: url_host(F.col(url)), path: url_path(F.col(url))})

    def key(labels: int, length: int) -> Column:
        suffix = F.substring_index(F.col(host), ".", -labels)
        enough = (F.length(host) - F.length(F.translate(F.col(host), ".", "")) + 1 >= labels) & (F.length(path) >= length)
        return F.when(enough, F.concat(suffix, F.substring(F.col(path), 1, length)))

    asked = F.array_compact(F.array(*(key(*shape) for shape in shapes)))
    universe = keep(parsed.select(F.explode(asked).alias("key")).distinct().select("key", *(h.alias(f"h{i + 1}") for i, h in enumerate(_hash_columns(F.col("key"))))), "url-keys")
    levels = build_cascade(universe, listed)
    if sum(x.n_bits for x in levels) > 8 * 256e6:
        raise ValueError("the list is too long to broadcast its cascade")
    sent = df.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("array<boolean>")
    def held(hashes: pd.Series) -> pd.Series:
        rows = [np.asarray(x, np.int64) for x in hashes]
        flat = np.concatenate(rows).reshape(-1, 2).astype(np.uint64) if len(rows) else np.empty((0, 2), np.uint64)
        found = cascade_holds(sent.value, flat) if len(flat) else np.empty(0, bool)
        return pd.Series(np.split(found, np.cumsum([len(x) // 2 for x in rows])[:-1]) if len(rows) else [])

    keys, is_held = "__keys", "__held"
    out = parsed.withColumn(keys, asked)
    out = out.withColumn(is_held, held(F.flatten(F.transform(keys, lambda k: F.array(*_hash_columns(k))))))
    members = F.transform(F.filter(F.arrays_zip(F.col(keys).alias("k"), F.col(is_held).alias("h")), lambda x: x["h"]), lambda x: x["k"])
    out = out.withColumn(keys, members)
    fitting = F.filter(keys, lambda k: k.isin(rule_keys))
    longest = F.aggregate(fitting, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    out = out.withColumn(rule, longest)
    own = F.lit(None).cast("string")
    for says, k in rules:
        own = F.when(F.col(rule) == k, says).otherwise(own)
    blocked = F.exists(keys, lambda k: ~k.contains("/"))
    return out.withColumn(verdict, F.coalesce(own, F.when(blocked, "block").otherwise("allow"))).drop(keys, is_held)


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    upper = f"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}')"
    rules = ", ".join(f"('{says}', '{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}', '{k}')" for says, k in RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return f"""
WITH rules(says, rule_host, rule_path, rule) AS (VALUES {rules}),
blocked(name) AS (VALUES {hosts}),
parsed AS (SELECT row_number() OVER () AS r, page_id, {upper} AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
         FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
         GROUP BY r),
hosts AS (SELECT DISTINCT r FROM parsed JOIN blocked ON host = name OR ends_with(host, '.' || name))
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.says, CASE WHEN hosts.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN best USING (r) LEFT JOIN hosts USING (r)"""


SQL = _sql()
