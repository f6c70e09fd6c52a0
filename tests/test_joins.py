"""Joins of near values: right at the edges, and without a pair for each two rows of a key."""

import threading

from oracle import rows_of

import plansmith.operators  # noqa: F401
from plansmith.registry import ORACLE, QUERIES

SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
DUCK = "create view customer as select * from read_parquet('{}/customer.parquet/*.parquet')"


def duck_customers(sql, folder):
    import duckdb

    c = duckdb.connect()
    c.execute(DUCK.format(folder))
    return c.execute(sql).df()


def test_self_join_at_the_edges_of_cells(spark, tmp_path):
    near = [0.0, -0.0, 49.99, 50.0, 50.01, 63.99, 64.0, 113.99, 114.0, -0.01, -49.99, -50.0, -64.0, -114.0, 1e17, 1e17 + 32, 1e30, -1e30, 5e-324, float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, "c", i % 2, v, "s") for i, v in enumerate(v for v in near for _ in range(4))] + [(500, "c", None, 0.0, "s"), (501, "c", None, 0.0, "s"), (0, "c", 0, 1.0, "s")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["join_self"](spark, str(tmp_path)).toPandas()
    assert len(got) and rows_of(got) == rows_of(duck_customers(ORACLE["join_self"], tmp_path))


def test_self_join_of_a_large_group_is_not_quadratic(spark, tmp_path):
    n = 120000  # 7.2 billion pairs in the group, of which only the last is near
    c = spark.range(n).selectExpr("id AS c_custkey", "'c' AS c_name", "1 AS c_nationkey", f"if(id = {n - 1}, id - 1, id) * 1000D AS c_acctbal", "'s' AS c_mktsegment")
    c.write.parquet(f"{tmp_path}/customer.parquet")
    spark.sparkContext.setJobGroup("near", "near", True)
    timer = threading.Timer(60, spark.sparkContext.cancelJobGroup, ["near"])
    timer.start()
    try:
        assert [tuple(r) for r in QUERIES["join_self"](spark, str(tmp_path)).collect()] == [(n - 2, n - 1)]
    finally:
        timer.cancel()
        spark.sparkContext._jsc.sc().clearJobGroup()
