"""Secret scans over a trigram inverted index, with DataFrame functions only.

A Boolean trigram query is derived from each rule's regular expression. The index
holds the postings (trigram, doc_id) of the trigrams that some query asks for,
found in the lower-cased whole text. Postings are brought together by document, the queries
are evaluated on them, and a rule's expression runs only on the documents that pass; a
rule without a mandatory trigram (a bare run of hex digits) scans every text.

Spans count code points, ends exclusive. A match's place follows from the lengths of
what lies between the matches, so the expression is never run from Python.

Nulls: a null text is empty; rows without a doc_id are scanned like others. Rows
that repeat a doc_id share candidates, which are verified row by row. An empty
table gives an empty result. Other columns are passed through; columns of the
input named like those added here are replaced.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, sheltered
from .trigrams import trigram_query, vocabulary


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + f"|{either_case('api')}_?{either_case('key')}"
#: Fixed values: (kind, expression, group whose length counts, least length, part of the contract).
#: Of the contract's unbounded runs only those long enough are matched here; shorter ones
#: would be dropped, and a run's rest cannot hold a longer match.
RULES = (
    ("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, False),
)
QUERIES = {kind: trigram_query(regex) for kind, regex, *_ in RULES}
VOCABULARY = sorted(set().union(*map(vocabulary, QUERIES.values())))
BLOCK = 256


def postings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: (trigram, key), trigram as its number in VOCABULARY."""
    low = df.select(key, F.lower(text).alias("low"))
    hits = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), n) for n, t in enumerate(VOCABULARY))))
    return low.select(F.explode(hits).alias("trigram"), key)


def _holds(query, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, VOCABULARY.index(query))
    return functools.reduce(operator.and_ if query[0] == "and" else operator.or_, (_holds(q, have) for q in query[1]))


def candidates(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, and for each rule with a trigram query whether the postings satisfy it."""
    together = index.groupBy(key).agg(F.collect_set("trigram").alias("have"))
    asked = {kind: q for kind, q in QUERIES.items() if q is not None}
    found = together.select(key, *(_holds(q, F.col("have")).alias(f"may_{kind}") for kind, q in asked.items()))
    return found.where(functools.reduce(operator.or_, (F.col(f"may_{kind}") for kind in asked)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _blocks(lengths: Column) -> Column:
    """Sums of blocks, so that running sums of many matches in one text cost little more than of few."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda k: _sum(F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK))))


def _before(blocks: Column) -> Column:
    return F.transform(blocks, lambda _, k: _sum(F.slice(blocks, F.lit(1), k)))


def _ends(lengths: Column, before: Column) -> Column:
    """Running sums of lengths."""
    place = lambda i: F.floor(i / BLOCK).cast("int")
    return F.transform(lengths, lambda _, i: F.get(before, place(i)) + _sum(F.slice(lengths, place(i) * BLOCK + 1, i % BLOCK + 1)))


def _span(ends: Column, kind: int, least: int):
    """For the i-th match and its size: its span, or null if it is too short."""
    return lambda size, i: F.when(size >= least, F.struct(F.get(ends, 2 * i).alias("start"), F.lit(kind).alias("kind"), F.get(ends, 2 * i + 1).alias("end")))


def with_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with base_spans and all_spans: array<struct<start, kind, end>> in order, kind by number in RULES."""
    index = keep(postings(df, key, text), "postings")
    found = keep(candidates(index, key).withColumnRenamed(key, "__key"), "candidates")
    df = df.drop("base_spans", "all_spans", *(c for c in found.columns if c in df.columns))
    df = df.join(found, F.col(key).eqNullSafe(F.col("__key")), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    raw = {}
    for kind, regex, group, least, _ in RULES:
        go = F.col(f"may_{kind}") if QUERIES[kind] is not None else F.lit(True)
        go = go & body.rlike(regex)  # most texts are left here
        matches = F.regexp_extract_all(body, F.lit(regex), F.lit(0))
        counted = matches if not group else F.regexp_extract_all(body, F.lit(regex), F.lit(group))
        raw[kind] = F.when(go, F.struct(F.transform(F.split(body, regex), F.length).alias("between"), F.transform(matches, F.length).alias("matched"), F.transform(counted, F.length).alias("counted")))
    df = df.withColumns({f"__{k}": c for k, c in raw.items()})
    both = {kind: F.flatten(F.transform(F.arrays_zip(F.slice(F.col(f"__{kind}.between"), F.lit(1), F.size(f"__{kind}.matched")).alias("b"), F.col(f"__{kind}.matched").alias("m")), lambda x: F.array(x["b"], x["m"]))) for kind in raw}
    df = df.withColumns({f"__l_{k}": c for k, c in both.items()})
    # Columns of their own: inside a lambda they would be computed for each element.
    df = df.withColumns({f"__s_{k}": _blocks(F.col(f"__l_{k}")) for k in raw})
    df = df.withColumns({f"__b_{k}": _before(F.col(f"__s_{k}")) for k in raw})
    df = df.withColumns({f"__e_{k}": _ends(F.col(f"__l_{k}"), F.col(f"__b_{k}")) for k in raw})
    spans = {}
    for n, (kind, _, _, least, _) in enumerate(RULES):
        one = F.transform(F.col(f"__{kind}.counted"), _span(F.col(f"__e_{kind}"), n, least))
        spans[kind] = F.coalesce(F.array_compact(one), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    base = F.sort_array(F.concat(*(spans[k] for k, *_, own in RULES if own)))
    every = F.sort_array(F.concat(*spans.values()))
    df = df.withColumns({"base_spans": base, "all_spans": every})
    return df.drop("__key", *found.columns, *(f"{p}{k}" for k in raw for p in ("__", "__l_", "__s_", "__b_", "__e_")))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k, *_ in RULES))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every span replaced by a mark; overlapping spans by one. A text without spans, null too, stays as it is."""
    df, restore = sheltered(df, key, text)
    found = with_spans(df, key, text)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        touching = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)) > s["start"])
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(touching, merged).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    found = found.withColumn("__merged", F.aggregate("all_spans", none, join))
    merged = F.col("__merged")
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(merged, i - 1)["end"])
    pieces = F.transform(F.sequence(F.lit(0), F.size(merged)), lambda i: F.substring(F.col(text), start(i) + 1, F.coalesce(F.get(merged, i)["start"], F.length(text)) - start(i)))
    cleaned = F.when(F.size(merged) > 0, F.array_join(pieces, mark)).otherwise(F.col(text))
    return restore(found.withColumn(text, cleaned))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(documents)
    count = lambda n: F.size(F.filter("base_spans", lambda s: s["kind"] == n)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base_spans"), 256).alias("base_sha256"), written("all_spans").alias("spans"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, (kind, regex, group, least, own) in enumerate(RULES):
        parts.append(f"""SELECT r, {n} AS n, '{kind}' AS kind, {own} AS own, {least} AS least,
  string_split_regex(t, {quoted(regex)}) AS between, regexp_extract_all(t, {quoted(regex)}) AS matched,
  regexp_extract_all(t, {quoted(regex)}, {group}) AS counted FROM d WHERE regexp_matches(t, {quoted(regex)})""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT r, n, kind, own, least, unnest(range(1, len(matched) + 1)) AS i, unnest(list_transform(between[1:len(matched)], lambda x: length(x))) AS b,
        unnest(list_transform(matched, lambda x: length(x))) AS m, unnest(list_transform(counted, lambda x: length(x))) AS c FROM m),
e AS (SELECT *, sum(b + m) OVER (PARTITION BY r, n ORDER BY i) AS stop FROM p),
s AS (SELECT r, n, own, stop - m AS start, kind || ':' || (stop - m) || ':' || stop AS span FROM e WHERE c >= least),
a AS (SELECT r, count(*) FILTER (n = 0) AS n0, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2,
        string_agg(span, ',' ORDER BY start, n) FILTER (own) AS base, string_agg(span, ',' ORDER BY start, n) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


SQL = _sql()
