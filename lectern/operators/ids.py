"""Dense identities and ranges without a global sort of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def dense_ids(rows: DataFrame, groups: DataFrame, key: str, order: list[Column], ordinal: str, name: str = "node_id", start: int = 0) -> DataFrame:
    """rows with ids 1..N (plus start), ordered by their group's order and then by ordinal 1..n in the group.

    groups: key and what orders it. Only the groups, far fewer than rows, are numbered one
    after the other; a row's id is its group's offset plus its ordinal. Ordering groups
    goes through range partitions, whose sizes alone are summed up in one place.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    placed = running_offsets(groups.select(key, *(c.alias(f"__o{i}") for i, c in enumerate(order))).join(counts, key), [f"__o{i}" for i in range(len(order))], "__n")
    return rows.join(placed.select(key, "__before"), key).withColumn(name, F.col("__before") + F.col(ordinal) + F.lit(start).cast("bigint")).drop("__before")


def running_offsets(groups: DataFrame, order: list[str], size: str) -> DataFrame:
    """groups with __before: the sizes of all groups before each, in order.

    Groups are ranged once, and written with the number of their range partition: whatever is
    taken from that table belongs to the same partitions, however a later plan prunes it. Each
    partition sums up its own groups; then the partitions' totals, a few rows, are summed up and added.
    """
    ranged = written(groups.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("__inside", F.coalesce(F.sum(size).over(own), F.lit(0)))
    totals = ranged.groupBy("__part").agg(F.sum(size).alias("__total"))
    earlier = totals.agg(F.collect_list(F.struct("__part", "__total")).alias("__all"))  # one entry per partition
    before = F.aggregate(F.filter("__all", lambda x: x["__part"] < F.col("__part")), F.lit(0).cast("bigint"), lambda a, x: a + x["__total"])
    return inside.crossJoin(F.broadcast(earlier)).withColumn("__before", F.col("__inside") + before).drop("__part", "__inside", "__all")


def ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Maximal runs of consecutive distinct integers: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(value)
    runs = df.select(*keys, value).distinct().withColumn("__island", F.col(value) - F.row_number().over(w))
    return runs.groupBy(*keys, "__island").agg(F.min(value).alias("start"), F.max(value).alias("end")).drop("__island")


def in_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", name: str = "value") -> DataFrame:
    """Inverse of :func:`ranges`. Empty ranges give nothing."""
    return df.where(F.col(start) <= F.col(end)).select(*keys, F.explode(F.sequence(start, end)).alias(name))
