"""Ordered operators: runs, carried values, segments and marker topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: list[str], same: list[str], ordinal: str | None = None) -> DataFrame:
    """df with run: the number of the maximal run of rows that agree in same (null agrees with null).

    ordinal: where it does not grow by one, a run ends too.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.lag(F.lit(1)).over(w).isNull()
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if ordinal:
        change = change | (F.col(ordinal) != F.lag(ordinal).over(w) + 1)
    marked = df.withColumn("__change", F.when(change, 1).otherwise(0))
    return marked.withColumn("run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__change")


def carried(value: Column, resets: Column, keys: list[str], order: list[str]) -> Column:
    """The last value that was set, nulled from a reset on."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    update = F.when(resets, F.struct(F.when(F.lit(False), value).alias("x"))).when(value.isNotNull(), F.struct(value.alias("x")))
    return F.last(update, ignorenulls=True).over(w)["x"]


def running_length(text: Column, keys: list[str], order: list[str]) -> Column:
    """Characters before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))


def segments(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """events with until: where the next event of the same keys stands (null: the end)."""
    return events.withColumn("until", F.lead(order).over(Window.partitionBy(*keys).orderBy(order)))


def step_class(number: Column, before: Column) -> Column:
    """How a marker's number follows the one before: first, invalid, duplicate, decreasing, gap or next."""
    return (
        F.when(number.isNull(), "invalid").when(before.isNull(), "first").when(number == before, "duplicate")
        .when(number < before, "decreasing").when(number > before + 1, "gap").otherwise("next")
    )


def topology(markers: DataFrame, keys: list[str], order: list[str], number: str, words_before: str | None = None) -> DataFrame:
    """markers with before (the preceding number) and step; no_words where no word stands between two markers."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = markers.withColumn("before", F.lag(number).over(w))
    out = out.withColumn("step", step_class(F.col(number), F.col("before")))
    return out if words_before is None else out.withColumn("no_words", F.col(words_before) == F.lag(words_before).over(w))


def missing_numbers(stepped: DataFrame, number: str, most: int = 256) -> DataFrame:
    """One row for each number that a gap leaves out; gaps wider than most are left to the step."""
    gaps = stepped.where((F.col("step") == "gap") & (F.col(number) - F.col("before") - 1 <= most))
    return gaps.withColumn("missing", F.explode(F.sequence(F.col("before") + 1, F.col(number) - 1)))
