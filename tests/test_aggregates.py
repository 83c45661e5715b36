"""Digests of tables."""

from lectern import registry
from lectern.operators import aggregates


def test_digests_depend_on_rows_and_not_on_order(spark):
    def digest(rows):
        return spark.createDataFrame(rows, "a int, b string").repartition(3).agg(aggregates.order_free_digest(["a", "b"])).collect()[0][0]

    rows = [(1, "x"), (2, None), (None, "y"), (None, None)]
    assert digest(rows) == digest(rows[::-1])
    different = [rows, rows[:3], [(1, "x"), (1, "x")], [(2, "x"), (2, "x")], [(1, None)], [(None, "1")], []]
    assert len({digest(r) for r in different}) == len(different)


def test_digests_are_registered_over_small_and_large_tables():
    sql = registry.ORACLE_SQL["table_digests"]
    assert "table_digests" in registry.QUERIES and all(f"FROM {t})" in sql for t in ("region", "nation", "lineitem"))
