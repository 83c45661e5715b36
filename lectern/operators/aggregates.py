"""Aggregates of audits: roll-ups, examples, unanimity, histograms and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_each(df: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """The same measures by each key on its own and over all: dimension, key_value, measures. One grouping-sets pass."""
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = df.groupingSets(sets, *(F.col(k) for k in keys)).agg(*measures, *(F.grouping(k).alias(f"__g_{k}") for k in keys))
    dimension, value = F.lit("all"), F.lit(None).cast("string")
    for k in keys:
        dimension = F.when(F.col(f"__g_{k}") == 0, k).otherwise(dimension)
        value = F.when(F.col(f"__g_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("key_value"), *(c for c in grouped.columns if c not in keys and not c.startswith("__g_")))


def smallest(df: DataFrame, keys: list[str], value: str, most: int = 3) -> DataFrame:
    """The smallest distinct values of each group, ranked; the feature is the top list."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.select(*keys, value).distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def unanimous(value: str, null_counts: bool = False) -> Column:
    """The one value of a group, or null if there are several. null_counts: null is a value of its own."""
    one = F.min(value).eqNullSafe(F.max(value))
    if null_counts:
        one = one & ((F.count(value) == 0) | (F.count(value) == F.count("*")))
    return F.when(one, F.min(value))


def histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups have how many rows: size, n_groups."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def preferred(df: DataFrame, keys: list[str], rank: str, item: str) -> DataFrame:
    """The item of greatest rank in each group, whether others tie with it, and how many ranks are missing."""
    best = F.max(F.struct(F.col(rank), F.negative(F.col(item)).alias("minus")))
    g = df.groupBy(*keys).agg(best.alias("best"), F.count("*").alias("n_items"), F.count(F.when(F.col(rank).isNull(), 1)).alias("n_missing"))
    ties = df.groupBy(*keys, rank).agg(F.count("*").alias("n_tied"))
    out = g.join(ties, [*keys], "inner").where(F.col(rank).eqNullSafe(F.col("best")[rank]))
    return out.select(*keys, F.negative(F.col("best.minus")).alias(item), F.col(f"best.{rank}").alias(rank), (F.col("n_tied") > 1).alias("tied"), "n_items", "n_missing")


def order_free_digest(columns: list[str]) -> Column:
    """As an aggregate of fixed size: count, and the sums of two 60-bit pieces of each row's hash. Repeated rows count as often as they occur."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns)), 256)
    pieces = (F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string") for at in (1, 16))
    return F.concat_ws("-", F.count("*").cast("string"), *pieces)
