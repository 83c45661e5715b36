"""Joins by key, interval, rule table and identity."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, outcome (matched, left_only, right_only, mismatch) and the fields that differ."""
    l, r = left.alias("l"), right.alias("r")
    joined = l.withColumn("__l", F.lit(True)).alias("l").join(r.withColumn("__r", F.lit(True)).alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields))) if fields else F.array().cast("array<string>")
    outcome = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").when(F.size(differ) > 0, "mismatch").otherwise("matched")
    return joined.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), outcome.alias("outcome"), F.when(outcome == "mismatch", F.array_join(differ, ",")).alias("differing"))


def in_interval(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """points joined with the spans of the same key that hold them (inclusive).

    With a width, both sides meet in buckets of that width as well, so that a key
    with very many spans does not compare every point with each of them.
    """
    if width is None:
        return points.join(spans, key).where(F.col(point).between(F.col(start), F.col(end)))
    bucket = lambda c: F.floor(F.col(c) / width)
    p = points.withColumn("__b", bucket(point))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(s, [key, "__b"]).where(F.col(point).between(F.col(start), F.col(end))).drop("__b")


def crosswalk(rows: DataFrame, rules: list[tuple], keys: list[str], value: str, name: str = "target") -> DataFrame:
    """rows with value shifted by the rule (keys..., low, high, offset) that covers it; null where none does.

    The rules are a fixed list in the program, so they are expressions and no join.
    """
    target = F.lit(None).cast("bigint")
    for *own, low, high, offset in reversed(rules):
        fits = functools.reduce(operator.and_, (F.col(k) == v for k, v in zip(keys, own, strict=True)), F.col(value).between(low, high))
        target = F.when(fits, F.col(value) + offset).otherwise(target)
    return rows.withColumn(name, target.cast("bigint"))


def lookup(rows: DataFrame, dimension: DataFrame, keys: list[str], found: str = "found") -> DataFrame:
    """Left join on keys with a flag, so that a missing key differs from a null value."""
    d = dimension.withColumn(found, F.lit(True))
    return rows.join(d, keys, "left").withColumn(found, F.coalesce(found, F.lit(False)))


def pairs_by_identity(rows: DataFrame, identity: str, key: str, carry: list[str]) -> DataFrame:
    """Pairs (left before right) of rows that share an identity, through the identity's first row.

    Each row is paired with the least key of its identity: all members are connected, and a
    large group gives as many pairs as it has members, not the square.
    """
    first = rows.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.min_by(F.struct(key, *carry), key).alias("__first"))
    joined = rows.join(first, identity).where(F.col(key) != F.col(f"__first.{key}"))
    return joined.select(identity, F.col(f"__first.{key}").alias("left"), F.col(key).alias("right"), *(x for c in carry for x in (F.col(f"__first.{c}").alias(f"left_{c}"), F.col(c).alias(f"right_{c}"))))


def edge_pairs(nodes: DataFrame, edges: DataFrame, node: str = "node_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """nodes with edges with nodes: columns prefixed src_ and dst_, edge columns as they are."""
    a = nodes.select(*(F.col(c).alias(f"src_{c}") for c in nodes.columns))
    b = nodes.select(*(F.col(c).alias(f"dst_{c}") for c in nodes.columns))
    return edges.join(a, F.col(src) == F.col(f"src_{node}")).join(b, F.col(dst) == F.col(f"dst_{node}"))


def bijection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys on both sides, on the left only, on the right only."""
    l = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    r = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    return l.join(r, keys, "full_outer").agg(
        F.count(F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), 1)).alias("n_both"),
        F.count(F.when(F.col("__r").isNull(), 1)).alias("n_left_only"), F.count(F.when(F.col("__l").isNull(), 1)).alias("n_right_only"))


def cascade(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule whose condition holds. Null conditions do not hold."""
    out = F.lit(otherwise).cast("string")
    for name, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out
