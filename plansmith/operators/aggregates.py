"""Aggregates: global, grouped, sorted, distinct, over grouping sets, and every aggregate function of the plans' vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from plansmith.registry import query, table

_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def money(column: str):
    """An exact sum of amounts, the same in any order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, {_MONEY.format('l_extendedprice')} AS price, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
def agg_global(spark, sf_dir):
    """Aggregate."""
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), money("l_extendedprice").alias("price"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query(
    f"""SELECT l_returnflag, l_linestatus, {_MONEY.format('l_quantity')} AS quantity, {_MONEY.format('l_extendedprice')} AS price,
    round({_MONEY.format('l_extendedprice')} / count(*), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def agg_group(spark, sf_dir):
    """HashAggregate: partial sums before the exchange."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"), F.round(money("l_extendedprice") / F.count("*"), 6).alias("mean"), F.count("*").alias("n"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1")
def agg_sorted(spark, sf_dir):
    """GroupAggregate / VectorSortAggregate: an aggregate that needs its group's order."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("listagg(o_orderstatus, '') within group (order by o_orderkey)").alias("statuses"))


@query("SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1")
def agg_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def agg_group_only(spark, sf_dir):
    """Group / VectorGroup: groups without an aggregate."""
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


_SETS = "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS no_status FROM {} GROUP BY {}"


def _sets(spark, sf_dir, name, by):
    table(spark, sf_dir, "orders").createOrReplaceTempView(name)
    return spark.sql(f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, cast(grouping(o_orderstatus) AS int) AS no_status FROM {name} GROUP BY {by}")


@query(_SETS.format("orders", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def agg_grouping_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "gs_orders", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query(_SETS.format("orders", "ROLLUP (o_orderstatus, o_orderpriority)"))
def agg_rollup(spark, sf_dir):
    return _sets(spark, sf_dir, "ro_orders", "ROLLUP (o_orderstatus, o_orderpriority)")


@query(_SETS.format("orders", "CUBE (o_orderstatus, o_orderpriority)"))
def agg_cube(spark, sf_dir):
    return _sets(spark, sf_dir, "cu_orders", "CUBE (o_orderstatus, o_orderpriority)")


#: Aggregates of two columns and of one, by their common names (fixed values).
PAIRED = ["corr", "covar_pop", "covar_samp", "regr_avgx", "regr_avgy", "regr_count", "regr_intercept", "regr_r2", "regr_slope", "regr_sxx", "regr_sxy", "regr_syy"]
SINGLE = ["stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp"]


def _statistics(dialect: str) -> list[str]:
    # regr_syy and the like differ in the last digits between engines: rounded to significant ones
    rounded = "round(CAST({x} AS DOUBLE), 3)"
    return [f"{rounded.format(x=f'{f}(l_quantity)')} AS {f}" for f in SINGLE] + [f"{rounded.format(x=f'{f}(l_quantity, l_linenumber)')} AS {f}" for f in PAIRED]


@query(f"SELECT l_returnflag, {', '.join(_statistics('duckdb'))} FROM lineitem GROUP BY 1")
def agg_stat(spark, sf_dir):
    """All statistical aggregates in one pass."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.expr(x) for x in _statistics("spark")])


@query("SELECT l_linestatus, bool_and(l_quantity > 0) AS all_some, bool_or(l_quantity > 49) AS any_many, bool_and(l_tax > 0.01) AS every_taxed FROM lineitem GROUP BY 1")
def agg_bool(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.bool_and(F.expr("l_quantity > 0")).alias("all_some"), F.bool_or(F.expr("l_quantity > 49")).alias("any_many"), F.every(F.expr("l_tax > 0.01")).alias("every_taxed"))


@query("SELECT l_returnflag, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x FROM lineitem GROUP BY 1")
def agg_bit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.bit_and("l_partkey").alias("a"), F.bit_or("l_partkey").alias("o"), F.bit_xor("l_partkey").alias("x"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, ';' ORDER BY n_name DESC) AS back FROM nation GROUP BY 1")
def agg_listagg(spark, sf_dir):
    """STRING_AGG, LISTAGG and GROUP_CONCAT."""
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey")
    return g.agg(F.expr("listagg(n_name, ',') within group (order by n_name)").alias("names"), F.expr("string_agg(n_name, ';') within group (order by n_name desc)").alias("back"))


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS med, quantile_disc(l_quantity, 0.9) AS d9 FROM lineitem GROUP BY 1")
def agg_percentile(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return g.agg(*[F.expr(f"{f}({p}) within group (order by l_quantity)").alias(n) for f, p, n in (("percentile_cont", 0.25, "q1"), ("percentile_cont", 0.5, "med"), ("percentile_disc", 0.9, "d9"))])


@query("SELECT n_regionkey, list_sort(list(n_nationkey)) AS nations FROM nation GROUP BY 1")
def agg_array(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.array_agg("n_nationkey")).alias("nations"))


@query("SELECT s, (SELECT p FROM (SELECT o_orderpriority AS p, count(*) AS c FROM orders WHERE o_orderstatus = s GROUP BY 1 ORDER BY c DESC, p LIMIT 1)) AS most FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)")
def agg_mode(spark, sf_dir):
    """MODE, ties to the smallest value."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.expr("mode() within group (order by o_orderpriority)").alias("most"))


@query("SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS keys, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_nationkey) || '}' AS object FROM nation GROUP BY 1")
def agg_json(spark, sf_dir):
    """JSON_AGG and JSON_OBJECT_AGG."""
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return g.select("n_regionkey", F.to_json(F.col("x.n_nationkey")).alias("keys"), F.to_json(F.map_from_arrays("x.n_name", "x.n_nationkey")).alias("object"))


@query()
def agg_approx(spark, sf_dir):
    """APPROX_COUNT_DISTINCT: a sketch of fixed size; engines' sketches differ, so no SQL."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query()
def agg_xml(spark, sf_dir):
    """XMLAGG."""
    x = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    return x.select("n_regionkey", F.array_join(F.transform("n", lambda v: F.concat(F.lit("<n>"), v, F.lit("</n>"))), "").alias("xml"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def agg_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("SELECT CAST(max(n) AS BIGINT) AS most, CAST(count(*) AS BIGINT) AS groups FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)")
def agg_two_level(spark, sf_dir):
    """An aggregate over an aggregate."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("groups"))
