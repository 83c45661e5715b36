"""Quality rules per document and per host, with DataFrame functions only.

Every document gets counts and a verdict of its own (``base_failed``). Each rule's
failures are counted by host (here: ``source``), partially before the shuffle. A
host's failure rate is shrunk towards that of all hosts with a beta prior whose
two parameters are fitted to the hosts' rates by their moments, so that a host
with few documents is judged mostly by the prior. A host fails if a shrunk
rate exceeds the limit, and its verdict is joined back to its documents.

Nulls: a null text has no words and fails; a null source is a host of its own.
Rows are judged one by one, so repeated rows count as often as they occur. An
empty table gives an empty result. Texts are read whole. Other columns of the
input are dropped by :func:`judge_documents`, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep

BLANKS = " \t\n\x0b\x0c\r"
#: Shrunk failure rate above which a host fails.
HOST_LIMIT = 0.5
#: Hosts up to this many are broadcast (about 20 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 200_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("base", "symbols", "dup_lines")


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def _covered(grams: Column) -> Column:
    """Number of positions within five of the start of a gram that occurs twice; null grams: none do."""
    starts = F.filter(F.transform(grams, lambda x, k: F.when((x["g"] == F.get(grams, k - 1)["g"]) | (x["g"] == F.get(grams, k + 1)["g"]), x["i"])), lambda i: i.isNotNull())
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    done = F.aggregate(F.sort_array(starts), first, lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + F.least(F.lit(5), i + 5 - a["end"])).alias("n")))
    return F.coalesce(done["n"], F.lit(0))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns but text, and COUNTS of the whole text."""
    body = "__body"
    df = df.withColumn(body, F.coalesce(F.col(text), F.lit(""))).drop(text)
    words, lines, grams, ordered = "__words", "__lines", "__grams", "__ordered"
    df = df.withColumns({
        words: F.when(_trimmed(F.col(body)) == "", F.array().cast("array<string>")).otherwise(F.split(_trimmed(F.col(body)), SPACE)),
        lines: F.filter(F.split(body, "\n"), lambda x: _trimmed(x) != ""),
        "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"),
    }).drop(body)
    five = [F.col(words)] + [None] * 4

    def gram(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *(F.get(five[0], i + k) for k in range(1, 5)))

    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        grams: F.when(F.size(words) > 5, F.transform(F.slice(words, F.lit(1), F.size(words) - 4), gram)),
    }).drop(words, lines)
    some = F.size(F.array_distinct(grams)) < F.size(grams)
    df = df.withColumn(ordered, F.when(some, F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    return df.withColumn("n_repeat_words", _covered(F.col(ordered)).cast("long")).drop(grams, ordered)


def rule_failures() -> dict[str, Column]:
    c = {k: F.col(k) for k in COUNTS}
    return {
        "base": (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"]),
        "symbols": 100 * c["n_symbols"] > 10 * c["word_chars"],
        "dup_lines": 5 * c["n_dup_lines"] > c["n_words"],
    }


def host_verdicts(counted: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """host, and host_failed: whether some rule's shrunk failure rate exceeds the limit."""
    totals = counted.groupBy(host).agg(F.count("*").alias("n"), *(F.sum(F.when(failed, 1).otherwise(0)).alias(rule) for rule, failed in rule_failures().items()))
    totals = keep(totals, "hosts")
    # Moments of the hosts' rates, weighted by size: of all hosts, one row.
    moments = totals.agg(F.sum("n").alias("all_n"), *(x for r in RULES for x in ((F.sum(r) / F.sum("n")).alias(f"{r}_mean"), (F.sum(F.col(r) * F.col(r) / F.col("n")) / F.sum("n")).alias(f"{r}_square"))))
    verdict = F.lit(False)
    for r in RULES:
        mean, variance = F.col(f"{r}_mean"), F.col(f"{r}_square") - F.col(f"{r}_mean") * F.col(f"{r}_mean")
        strength = F.when(variance > 1e-12, F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / variance - 1))).otherwise(1e6)
        verdict = verdict | ((F.col(r) + mean * strength) / (F.col("n") + strength) > limit)
    return totals.crossJoin(F.broadcast(moments)).select(host, verdict.alias("host_failed"))


def judge_documents(df: DataFrame, host: str = "source", limit: float = HOST_LIMIT, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, COUNTS, base_failed, host_failed and kept of every row."""
    counted = keep(with_counts(df.select(*carry, F.col(host).alias("__host"), "text")), "counted")
    hosts = keep(host_verdicts(counted, "__host", limit).withColumnRenamed("__host", "__h"), "verdicts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    out = counted.join(hosts, F.col("__host").eqNullSafe(F.col("__h")), "left").drop("__host", "__h")
    base = rule_failures()["base"]
    return out.select(*carry, *COUNTS, base.alias("base_failed"), "host_failed", (~base & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge_documents(documents).drop("host_failed")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY r),
m AS (SELECT w.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered ON w.r = covered.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        100 * n_symbols > 10 * word_chars AS symbols, 5 * n_dup_lines > n_words AS dup_lines FROM m),
long AS (SELECT source, unnest(['base', 'symbols', 'dup_lines']) AS rule,
        unnest([base_failed, symbols, dup_lines]) AS failed FROM f),
hosts AS (SELECT source, rule, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS k FROM long GROUP BY ALL),
prior AS (SELECT rule, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS variance FROM hosts GROUP BY rule),
strong AS (SELECT rule, mean, CASE WHEN variance > 1e-12 THEN greatest(1.0, least(1e6, mean * (1 - mean) / variance - 1)) ELSE 1e6 END AS s FROM prior),
verdicts AS (SELECT source, bool_or((k + mean * s) / (n + s) > 0.5) AS host_failed FROM hosts JOIN strong USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source"""
