"""Queries that must see whole tables."""

from oracle import DATA
from pyspark.sql import functions as F

import plansmith.operators  # noqa: F401
from plansmith.registry import QUERIES, table


def test_partition_iterator_numbers_all_rows(spark):
    lines = table(spark, DATA, "lineitem")
    got = QUERIES["partition_iterator_all"](spark, DATA)
    assert got.count() == lines.count()
    assert got.select("l_orderkey").distinct().count() == lines.select("l_orderkey").distinct().count()


def test_outer_joins_keep_all_rows_of_both_tables(spark):
    orders, customers = table(spark, DATA, "orders").count(), table(spark, DATA, "customer").count()
    left, right, full = (QUERIES[f"join_{how}_all"](spark, DATA) for how in ("left", "right", "full"))
    assert left.count() == orders and left.where("c_mktsegment is null").count() > 0
    assert right.where("o_orderkey = -1").count() > 0
    assert full.where("o_orderkey <> -1").count() == orders
    matched = right.where("o_orderkey <> -1").count()
    alone = right.where("o_orderkey = -1").count()
    assert full.count() == orders + alone
    anti = QUERIES["join_anti_full_all"](spark, DATA)
    assert anti.where("c_custkey = -1").count() == orders - matched
    paired = table(spark, DATA, "orders").join(table(spark, DATA, "customer").where("c_acctbal > 0"), F.expr("o_custkey = c_custkey")).select("c_custkey").distinct().count()
    assert anti.where("o_orderkey = -1").count() == customers - paired


def test_merge_append_returns_the_whole_ordered_union(spark):
    got = [r.k for r in QUERIES["merge_append_all"](spark, DATA).collect()]
    assert len(got) == table(spark, DATA, "customer").count() + table(spark, DATA, "supplier").count()
    assert got == sorted(got)
