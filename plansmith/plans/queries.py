"""Plan analytics over the corpus, each query with SQL over the base columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plansmith.plans import analytics, corpus, parser, rules
from plansmith.registry import ORACLE, QUERIES, query

_N = corpus.NODES_SQL


def _parsed(spark, sf_dir):
    return parser.parse(corpus.stored_texts(spark, sf_dir))


@query(_N + "SELECT plan_id, ord, node_type, total_cost, plan_rows FROM n")
def parse_cost(spark, sf_dir):
    return _parsed(spark, sf_dir).select("plan_id", F.inline("ns")).select("plan_id", "ord", "node_type", "total_cost", "plan_rows")


@query(_N + "SELECT plan_id, ord, coalesce(act_rows, -1.0) AS act_rows, coalesce(loops, -1.0) AS loops, coalesce(act_time, -1.0) AS act_time, coalesce(executed, false) AS executed FROM n")
def parse_actual(spark, sf_dir):
    n = _parsed(spark, sf_dir).select("plan_id", F.inline("ns"))
    minus = F.lit(-1.0)
    return n.select("plan_id", "ord", F.coalesce("run.rows", minus).alias("act_rows"), F.coalesce("run.loops", minus).alias("loops"), F.coalesce("run.time", minus).alias("act_time"), F.coalesce("run.executed", F.lit(False)).alias("executed"))


@query(_N + "SELECT plan_id, ord, relation, streaming, filter FROM n")
def parse_text(spark, sf_dir):
    """Relations, kinds of movement and filters."""
    return _parsed(spark, sf_dir).select("plan_id", F.inline("ns")).select("plan_id", "ord", "relation", "streaming", "filter")


@query(_N + "SELECT plan_id, ord, coalesce(removed, -1.0) AS removed, sort_method, sort_key, coalesce(hash_batches, -1) AS hash_batches, coalesce(CAST(peak_kb AS DOUBLE), -1.0) AS peak_kb FROM n")
def parse_properties(spark, sf_dir):
    n = _parsed(spark, sf_dir).select("plan_id", F.inline("ns"))
    method = F.trim(F.regexp_replace("sort_method", "(Disk|Memory):.*$", ""))
    return n.select("plan_id", "ord", F.coalesce("removed", F.lit(-1.0)).alias("removed"), method.alias("sort_method"), "sort_key", F.coalesce("hash_batches", F.lit(-1)).alias("hash_batches"), F.coalesce("peak_kb", F.lit(-1.0)).alias("peak_kb"))


@query("SELECT DISTINCT l_orderkey AS plan_id, l_orderkey % 900 + 0.5 AS total_runtime FROM lineitem")
def parse_summary(spark, sf_dir):
    return _parsed(spark, sf_dir).select("plan_id", "total_runtime")


@query("SELECT kind, CAST(n AS BIGINT) AS n FROM (SELECT 'node' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT unnest(['header', 'separator', 'summary']), (SELECT count(DISTINCT l_orderkey) FROM lineitem))")
def classify_lines(spark, sf_dir):
    return parser.lines(corpus.stored_texts(spark, sf_dir)).where("kind <> 'property'").groupBy("kind").agg(F.count("*").alias("n"))


@query(_N + "SELECT plan_id, ord, coalesce(parent, -1) AS parent, depth FROM d")
def tree_parent(spark, sf_dir):
    n = _parsed(spark, sf_dir).select("plan_id", F.inline("ns"))
    return n.select("plan_id", "ord", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth")


@query(_N + "SELECT plan_id, anc, ord FROM cl")
def tree_closure(spark, sf_dir):
    return _parsed(spark, sf_dir).select("plan_id", F.inline("ns")).select("plan_id", F.explode("ancestors").alias("anc"), "ord")


@query(_N + "SELECT plan_id, ord, CAST(row_number() OVER (PARTITION BY plan_id, parent ORDER BY ord) - 1 AS INTEGER) AS child_idx, CAST(ord + (SELECT count(*) FROM cl WHERE cl.plan_id = d.plan_id AND cl.anc = d.ord) - (depth - 1) AS INTEGER) AS postorder FROM d")
def tree_order(spark, sf_dir):
    """A node's place among its parent's children, and its place in post-order."""
    return analytics.tree_order(parser.nodes(_parsed(spark, sf_dir)))


@query(_N + "SELECT plan_id, CAST(count(*) AS INTEGER) AS nodes, max(depth) AS max_depth, greatest(max(coalesce(act_time, 0.0)), 0.0) AS max_time, greatest(max(coalesce(act_rows, 0.0)), 0.0) AS max_rows FROM d GROUP BY 1")
def plan_stats(spark, sf_dir):
    return analytics.plan_stats(_parsed(spark, sf_dir))


# The rules once more, from the base columns: d is the node, cl and n tell what is above and below.
_ABOVE = "EXISTS (SELECT 1 FROM cl JOIN n a ON a.plan_id = cl.plan_id AND a.ord = cl.anc WHERE cl.plan_id = d.plan_id AND cl.ord = d.ord AND a.node_type IN ({}))"
_BELOW = "EXISTS (SELECT 1 FROM cl JOIN n b ON b.plan_id = cl.plan_id AND b.ord = cl.ord WHERE cl.plan_id = d.plan_id AND cl.anc = d.ord AND {})"
_KID = "EXISTS (SELECT 1 FROM d k WHERE k.plan_id = d.plan_id AND k.parent = d.ord AND {})"
_FIRST = "(SELECT arg_min({0}, ord) FROM d k WHERE k.plan_id = d.plan_id AND k.parent = d.ord)"
_SORTS, _STREAMS = "'Sort', 'VectorSort'", "'Streaming', 'VectorStreaming'"
_SUB = "filter LIKE '%SubPlan%'"
_SAME = _BELOW.format("b.node_type IN ('SeqScan', 'IndexScan', 'IndexOnlyScan', 'BitmapHeapScan', 'CStoreScan', 'PartitionedSeqScan') AND b.relation = d.relation")
_NODE_RULES = {
    "SCAN-001": "node_type IN ('SeqScan', 'PartitionedSeqScan') AND filter IS NULL AND plan_rows > 10000 AND NOT " + _ABOVE.format("'HashJoin', 'Hash', 'Sort', 'VectorSort', 'HashAggregate', 'GroupAggregate', 'Unique', 'MergeJoin', 'Materialize'"),
    "SCAN-004": f"node_type IN ('SeqScan', 'PartitionedSeqScan', 'CStoreScan', 'BitmapHeapScan') AND filter IS NOT NULL AND NOT {_SUB} AND act_rows IS NOT NULL AND ((act_rows > 0 AND plan_rows / act_rows > 10) OR coalesce(removed, 0) > 500)",
    "SCAN-005": "node_type IN ('IndexScan', 'IndexOnlyScan') AND act_rows * loops > 10000",
    "JOIN-001": "node_type = 'NestedLoop' AND (SELECT max(k.act_rows * k.loops) FROM d k WHERE k.plan_id = d.plan_id AND k.parent = d.ord) > 10000",
    "JOIN-002": "node_type = 'Hash' AND hash_batches > 1",
    "JOIN-003": "node_type IN ('HashJoin', 'MergeJoin') AND join_removed > 10000",
    "MEM-001": "sort_method = 'external merge'",
    "SORT-003": f"node_type IN ({_SORTS}) AND " + _BELOW.format(f"b.node_type IN ({_SORTS})"),
    "NET-001": "streaming = 'Broadcast' AND node_type = 'Streaming' AND act_rows > 10000",
    "EST-001": "act_rows > 0 AND act_rows / plan_rows > 100",
    "EST-004": "node_type = 'NestedLoop' AND act_rows > 0 AND act_rows / plan_rows > 100",
    "PUSH-001": "node_type = 'Streaming' AND streaming IN ('Redistribute', 'Broadcast')",
    "PUSH-002": f"node_type IN ({_STREAMS}) AND " + _BELOW.format(f"b.node_type IN ({_STREAMS})"),
    "TYPE-001": "node_type = 'SeqScan' AND filter = '(grade = ''17'')' AND removed > 10 AND removed / (removed + coalesce(act_rows, 0)) > 0.5",
    "TYPE-004": "filter LIKE '%~~ ''\\%%' ESCAPE '\\'",
    "SUBQ-001": f"node_type = 'SubqueryScan' OR ({_SUB} AND NOT " + _ABOVE.format("'SubqueryScan'") + ")",
    "REW-001": "filter LIKE '%IN (%'",
    "SUBQ-006": f"node_type = 'Update' AND ({_SUB} OR {_BELOW.format('b.' + _SUB)}) AND {_SAME}",
    "AGG-001": "node_type = 'GroupAggregate' AND act_rows > 10000 AND " + _KID.format("k.node_type = 'Sort'"),
    "AGG-002": "node_type = 'HashAggregate' AND hash_batches > 1",
    "PART-001": "node_type = 'PartitionedSeqScan' AND (filter LIKE '%to_char%' OR parts > 10)",
    "STATS-001": "node_type = 'SeqScan' AND plan_rows = 10 AND act_rows > 1000",
    "DIST-001": "node_type = 'Streaming' AND streaming = 'Redistribute' AND act_rows > 10000",
    "SKEW-001": "node_type = 'Streaming' AND streaming = 'Redistribute' AND act_rows > 100000 AND act_rows / plan_rows > 5",
    "ANTI-003": "node_type IN ('NestedLoop', 'VectorNestLoop') AND act_rows >= 10000 AND " + _KID.format("k.node_type IN ('IndexScan', 'IndexOnlyScan') AND k.filter IS NOT NULL AND k.removed > 0"),
    "ANTI-005": "node_type = 'Materialize' AND (SELECT m.node_type = 'Materialize' AND (SELECT arg_min(x.node_type, x.ord) FROM d x WHERE x.plan_id = m.plan_id AND x.parent = m.ord) IN ('NestedLoop', 'VectorNestLoop') FROM d m WHERE m.plan_id = d.plan_id AND m.ord = (SELECT min(k.ord) FROM d k WHERE k.plan_id = d.plan_id AND k.parent = d.ord))",
    "ANTI-007": f"node_type IN ({_SORTS}) AND act_rows >= 100000 AND EXISTS (SELECT 1 FROM cl JOIN n a ON a.plan_id = cl.plan_id AND a.ord = cl.anc WHERE cl.plan_id = d.plan_id AND cl.ord = d.ord AND a.streaming = 'Gather')",
    "ANTI-008": f"node_type IN ('NestedLoop', 'VectorNestLoop') AND act_rows >= 100000 AND (SELECT arg_min(coalesce(k.act_rows, -1), k.ord) FROM d k WHERE k.plan_id = d.plan_id AND k.parent = d.ord AND k.node_type IN ({_SORTS}) AND (k.act_rows IS NULL OR k.act_rows >= 100000)) >= 100000",
    "ANTI-009": "node_type = 'HashJoin' AND (plan_id, ord) IN (SELECT (plan_id, parent) FROM (SELECT plan_id, parent, act_rows, lag(act_rows) OVER w AS before, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY plan_id, parent ORDER BY ord)) AS k WHERE i = 2 AND before IS NOT NULL AND act_rows / greatest(before, 1.0) > 5)",
    "ANTI-010": "node_type = 'Unique' AND " + _ABOVE.format("'Unique'"),
    "ANTI-011": "node_type = 'IndexScan' AND heap_fetches > 10000",
    "ANTI-012": f"node_type IN ('HashAggregate', 'GroupAggregate') AND (SELECT count(*) FROM cl JOIN n a ON a.plan_id = cl.plan_id AND a.ord = cl.anc WHERE cl.plan_id = d.plan_id AND cl.ord = d.ord AND a.node_type IN ({_STREAMS})) > 1",
}
_PLAN_RULES = {"MEM-004": "max(peak_kb) > 102400", "VEC-001": "count(*) FILTER (node_type = 'RowAdapter') >= 2", "GEN-001": "max(depth) > 10"}
_BY_ID = {r.id: (i, r) for i, r in enumerate(rules.ALL)}


def _one(rule_id: str):
    others = tuple(r.id for r in rules.ALL if r.id != rule_id)

    def run(spark, sf_dir):
        found = rules.findings(_parsed(spark, sf_dir), rules.Config(disabled=others))
        return found.select("plan_id", F.coalesce("ord", F.lit(-1)).alias("ord"), "rule_id", "severity")

    return run


for _id, _where in (_NODE_RULES | _PLAN_RULES).items():
    _name = "rule_" + _id.lower().replace("-", "_")
    QUERIES[_name] = _one(_id)
    _what = f"'{_id}' AS rule_id, '{_BY_ID[_id][1].severity}' AS severity"
    ORACLE[_name] = _N + (f"SELECT plan_id, ord, {_what} FROM d WHERE {_where}" if _id in _NODE_RULES else f"SELECT plan_id, -1 AS ord, {_what} FROM d GROUP BY plan_id HAVING {_where}")

_RANK = {"Critical": 0, "Warning": 1, "Info": 2}
_FOUND = _N + ", f AS (" + " UNION ALL ".join(
    [f"SELECT plan_id, ord, '{i}' AS rule_id, {_BY_ID[i][0]} AS no, {_RANK[_BY_ID[i][1].severity]} AS rank, {int(_BY_ID[i][1].whole_plan)} AS phase FROM d WHERE {w}" for i, w in _NODE_RULES.items()]
    + [f"SELECT plan_id, NULL, '{i}', {_BY_ID[i][0]}, {_RANK[_BY_ID[i][1].severity]}, 1 FROM d GROUP BY plan_id HAVING {w}" for i, w in _PLAN_RULES.items()]
) + ")"
_ORDER = "rank, phase, CASE WHEN phase = 0 THEN ord ELSE no END, CASE WHEN phase = 0 THEN no ELSE coalesce(ord, -1) END"


@query(_FOUND + f" SELECT plan_id, rule_id, coalesce(ord, -1) AS ord, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY {_ORDER}) AS INTEGER) AS place FROM f")
def findings_ordered(spark, sf_dir):
    return rules.ordered(rules.findings(_parsed(spark, sf_dir))).select("plan_id", "rule_id", F.coalesce("ord", F.lit(-1)).alias("ord"), "place")


@query(_FOUND + f" SELECT plan_id, rule_id, coalesce(ord, -1) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, ord ORDER BY {_ORDER}) AS i FROM f) WHERE ord IS NULL OR i = 1")
def findings_dedup(spark, sf_dir):
    return rules.one_a_node(rules.findings(_parsed(spark, sf_dir))).select("plan_id", "rule_id", F.coalesce("ord", F.lit(-1)).alias("ord"))


@query(_FOUND + " SELECT rule_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT plan_id) AS BIGINT) AS plans FROM f GROUP BY 1")
def findings_by_rule(spark, sf_dir):
    """The flagship: findings of all rules over all plans."""
    return rules.findings(_parsed(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("plan_id").alias("plans"))


@query(_FOUND + " SELECT CAST(rank AS INTEGER) AS severity_rank, CAST(count(*) AS BIGINT) AS n FROM f WHERE rule_id NOT IN ('EST-001', 'PUSH-001') GROUP BY 1")
def findings_disabled(spark, sf_dir):
    """With two rules turned off."""
    found = rules.findings(_parsed(spark, sf_dir), rules.Config(disabled=("EST-001", "PUSH-001")))
    return found.groupBy("severity_rank").agg(F.count("*").alias("n"))


_QE = "CASE WHEN executed AND plan_rows > 0 AND act_rows > 0 THEN greatest(plan_rows, act_rows) / least(plan_rows, act_rows) END"
_HEAT = (
    _N
    + f""", q AS (SELECT *, coalesce({_QE}, 1.0) AS q, ({_QE}) IS NOT NULL AS counted, ln(1 + (SELECT count(*) FROM d k WHERE k.plan_id = d.plan_id AND k.parent = d.ord)) AS fan FROM d),
a AS (SELECT plan_id, ord, anc FROM cl UNION ALL SELECT plan_id, ord, ord FROM n),
h AS (SELECT q.plan_id, q.ord, any_value(q.parent) AS parent, any_value(q.q) AS q, any_value(q.counted) AS counted, any_value(q.plan_rows) AS plan_rows, any_value(q.act_rows) AS act_rows, exp(sum(ln(x.q))) AS path, sum(x.fan) AS down
    FROM q JOIN a ON a.plan_id = q.plan_id AND a.ord = q.ord JOIN q x ON x.plan_id = a.plan_id AND x.ord = a.anc GROUP BY 1, 2),
g AS (SELECT t.plan_id, t.ord, exp(sum(ln(x.q) * exp(-x.down)) * exp(coalesce(any_value(u.down), 0.0))) AS geo FROM h t JOIN a ON a.plan_id = t.plan_id AND a.anc = t.ord JOIN h x ON x.plan_id = a.plan_id AND x.ord = a.ord
    LEFT JOIN h u ON u.plan_id = t.plan_id AND u.ord = t.parent GROUP BY 1, 2)
"""
)


@query(_HEAT + " SELECT plan_id, ord, round(q, 6) AS q_error, CASE WHEN act_rows / plan_rows > 1.5 THEN 'Under' WHEN act_rows / plan_rows < 0.67 THEN 'Over' ELSE 'Accurate' END AS direction, CASE WHEN q < 2 THEN 'Negligible' WHEN q < 5 THEN 'Mild' WHEN q < 10 THEN 'Moderate' WHEN q < 50 THEN 'Severe' ELSE 'Extreme' END AS severity FROM h WHERE counted")
def heatmap_qerror(spark, sf_dir):
    return analytics.heatmap(_parsed(spark, sf_dir)).select("plan_id", "ord", F.round("q_error", 6).alias("q_error"), "direction", "severity")


@query(_HEAT + " SELECT plan_id, ord, round(ln(path), 6) AS log_path, round(ln(geo), 6) AS log_geo FROM h JOIN g USING (plan_id, ord) WHERE counted")
def heatmap_tree(spark, sf_dir):
    """Products from the root and nested geometric means, as logarithms."""
    return analytics.heatmap(_parsed(spark, sf_dir)).select("plan_id", "ord", F.round(F.log("path"), 6).alias("log_path"), F.round(F.log("subtree_geo"), 6).alias("log_geo"))


@query()
def heatmap_critical_path(spark, sf_dir):
    """The way down along the largest products; near-ties depend on the last digits, so no SQL."""
    return analytics.heatmap(_parsed(spark, sf_dir)).where("critical_path").select("plan_id", "ord")


@query(_HEAT + " SELECT plan_id, CAST(count(*) AS BIGINT) AS entries, round(max(q), 6) AS worst, CAST(count(*) FILTER (q >= 10) AS BIGINT) AS severe, CAST(count(*) FILTER (q >= 2) AS BIGINT) AS deviating FROM h WHERE counted GROUP BY 1")
def heatmap_summary(spark, sf_dir):
    return analytics.heatmap_summary(_parsed(spark, sf_dir)).withColumn("worst", F.round("worst", 6))


@query(_HEAT + " SELECT plan_id, ord, round(q, 6) AS q_error FROM h WHERE counted AND q >= 5")
def heatmap_hotspots(spark, sf_dir):
    """Entries of moderate severity and worse."""
    return analytics.heatmap(_parsed(spark, sf_dir)).where("severity IN ('Moderate', 'Severe', 'Extreme')").select("plan_id", "ord", F.round("q_error", 6).alias("q_error"))


_WATER = (
    _N
    + """, c AS (SELECT *, CASE WHEN executed THEN act_time * loops ELSE 0.0 END AS cpu, CAST(coalesce(peak_kb, 0) AS DOUBLE) AS mem, coalesce(sort_disk IS NOT NULL OR hash_batches > 1, false) AS spill FROM d),
a AS (SELECT plan_id, ord, anc FROM cl UNION ALL SELECT plan_id, ord, ord FROM n),
s AS (SELECT a.plan_id, a.anc AS ord, sum(c.cpu) AS subtree_cpu, max(c.mem) AS subtree_mem, count(*) - 1 AS below FROM a JOIN c ON c.plan_id = a.plan_id AND c.ord = a.ord GROUP BY 1, 2),
w AS (SELECT c.*, subtree_cpu, subtree_mem, ord + below - (depth - 1) AS postorder, CASE WHEN sum(cpu) OVER p > 0 THEN cpu / sum(cpu) OVER p * 100 ELSE 0.0 END AS cpu_percent,
    CASE WHEN max(mem) OVER p > 0 THEN mem / max(mem) OVER p * 100 ELSE 0.0 END AS mem_percent FROM c JOIN s USING (plan_id, ord) WINDOW p AS (PARTITION BY plan_id))
"""
)


@query(_WATER + " SELECT plan_id, ord, cpu, mem, spill, subtree_cpu, subtree_mem, round(cpu_percent, 6) AS cpu_percent, round(mem_percent, 6) AS mem_percent, cpu_percent >= 20 OR mem_percent >= 25 OR spill AS bottleneck FROM w")
def waterfall_nodes(spark, sf_dir):
    return analytics.waterfall(_parsed(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("cpu_percent", "mem_percent")}).drop("postorder")


@query(_WATER + " SELECT plan_id, CAST(r AS INTEGER) AS rank, ord, cpu FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY cpu DESC, postorder) AS r FROM w) WHERE r <= 5")
def waterfall_top5(spark, sf_dir):
    """Each plan's five largest nodes: a top-k report."""
    return analytics.top_consumers(analytics.waterfall(_parsed(spark, sf_dir)), "cpu")


@query(
    _FOUND
    + """, i AS (SELECT plan_id, list(rule_id) AS ids FROM f GROUP BY 1)
SELECT plan_id, CAST(0 AS INTEGER) AS no, 'StatisticsUpdate' AS kind FROM i WHERE len(list_filter(ids, lambda r: r LIKE 'EST-%')) >= 2
UNION ALL SELECT plan_id, 1, 'ConfigurationTuning' FROM i WHERE len(list_filter(ids, lambda r: r IN ('MEM-001', 'MEM-004', 'JOIN-002', 'AGG-002'))) >= 2
UNION ALL SELECT plan_id, 2, 'IndexOptimization' FROM i WHERE len(list_filter(ids, lambda r: r LIKE 'SCAN-%')) > 0 AND len(list_filter(ids, lambda r: r LIKE 'JOIN-%')) > 0
UNION ALL SELECT plan_id, 3, 'DistributionOptimization' FROM i WHERE len(list_filter(ids, lambda r: r LIKE 'PUSH-%')) > 0
UNION ALL SELECT plan_id, 4, 'QueryRewrite' FROM i WHERE list_contains(ids, 'SUBQ-006')
UNION ALL SELECT plan_id, 5, 'QueryRewrite' FROM i WHERE len(list_filter(ids, lambda r: r LIKE 'TYPE-%')) >= 2
UNION ALL SELECT plan_id, 6, 'ConfigurationTuning' FROM i WHERE len(list_filter(ids, lambda r: r LIKE 'VEC-%')) > 0"""
)
def suggestions(spark, sf_dir):
    return analytics.suggestions(rules.findings(_parsed(spark, sf_dir))).drop("confidence")


@query(
    _FOUND
    + """, c AS (SELECT plan_id, count(*) FILTER (rank = 0) AS c0, count(*) FILTER (rank = 1) AS c1 FROM f GROUP BY 1)
SELECT plan_id, arg_min(node_type, ord) AS root_op, arg_min(total_cost, ord) AS total_cost, plan_id % 900 + 0.5 AS total_time_ms, CAST(count(*) AS INTEGER) AS node_count, max(depth) AS plan_depth,
    round(coalesce(max(act_rows / plan_rows) FILTER (plan_rows >= 1), -1.0), 6) AS worst_est_ratio, coalesce(CAST(sum(sort_disk) AS DOUBLE), -1.0) AS spill_kb, coalesce(CAST(arg_min(peak_kb, ord) FILTER (peak_kb IS NOT NULL) AS DOUBLE), -1.0) AS peak_memory_kb,
    CASE WHEN bool_or(node_type IN ('Streaming', 'VectorStreaming')) THEN 'NotPushed' ELSE 'Local' END AS pushdown, coalesce(max(removed), -1.0) AS max_filter_removed,
    CAST(coalesce(any_value(c0), 0) AS BIGINT) AS critical_count, CAST(coalesce(any_value(c1), 0) AS BIGINT) AS warning_count FROM d LEFT JOIN c USING (plan_id) GROUP BY plan_id"""
)
def summary_row(spark, sf_dir):
    s = analytics.summary(_parsed(spark, sf_dir))
    minus = {c: F.coalesce(c, F.lit(-1.0)) for c in ("spill_kb", "peak_memory_kb", "max_filter_removed")} | {"worst_est_ratio": F.round(F.coalesce("worst_est_ratio", F.lit(-1.0)), 6)}
    return s.withColumns(minus).select("plan_id", "root_op", "total_cost", "total_time_ms", "node_count", "plan_depth", "worst_est_ratio", "spill_kb", "peak_memory_kb", "pushdown", "max_filter_removed", "critical_count", "warning_count")


@query("SELECT event_id, round(CASE WHEN t > 0 THEN value / t * 100 ELSE 0.0 END, 6) AS contribution, CASE WHEN t <= 0 THEN 'None' WHEN value / t * 100 > 50 THEN 'Primary' WHEN s > 0 AND value > m + 2 * s THEN 'Secondary' ELSE 'None' END AS bottleneck FROM (SELECT *, sum(value) OVER u AS t, avg(value) OVER u AS m, stddev_pop(value) OVER u AS s FROM events WINDOW u AS (PARTITION BY user_id))")
def session_bottleneck(spark, sf_dir):
    """Users as sessions, events as their steps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    return analytics.bottlenecks(e, "user_id", "value").select("event_id", F.round("contribution", 6).alias("contribution"), "bottleneck")


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS runs, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(CASE WHEN avg(value) > 0 THEN max(value) / avg(value) ELSE 1.0 END, 6) AS degradation FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def session_templates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value")
    return analytics.template_groups(e, "user_id", "event_type", "value").select("user_id", "event_type", "runs", F.round("total", 4).alias("total"), "least", "most", F.round("degradation", 6).alias("degradation"))


@query(
    _N
    + """, c AS (SELECT plan_id, """ + analytics.SHAPE_SQL + """ AS shape FROM n GROUP BY 1)
SELECT CAST(n AS BIGINT) AS plans, CAST(count(*) AS BIGINT) AS shapes FROM (SELECT count(*) AS n FROM c GROUP BY shape) GROUP BY 1"""
)
def plan_fingerprints(spark, sf_dir):
    """How many shapes of plans occur how often."""
    shapes = analytics.fingerprints(_parsed(spark, sf_dir)).groupBy("fingerprint").agg(F.count("*").alias("plans"))
    return shapes.groupBy("plans").agg(F.count("*").alias("shapes"))


_SAID = {
    "SCAN-005": "relation",
    "MEM-001": "sort_key",
    "EST-001": "CAST(CAST(act_rows AS BIGINT) AS VARCHAR)",
    "JOIN-002": "CAST(hash_batches AS VARCHAR)",
    "SKEW-001": "CAST(CAST(plan_rows AS BIGINT) AS VARCHAR)",
    "TYPE-001": "'grade'",
}


@query(_FOUND + " SELECT f.plan_id, f.ord, rule_id, CASE rule_id " + " ".join(f"WHEN '{i}' THEN {w}" for i, w in _SAID.items()) + " END AS told, relation, act_rows AS rows, plan_rows AS estimated FROM f JOIN d ON f.plan_id = d.plan_id AND f.ord = d.ord WHERE rule_id IN (" + ", ".join(f"'{i}'" for i in _SAID) + ")")
def findings_told(spark, sf_dir):
    """A figure or name out of the sentences of some rules, and their evidence."""
    f = rules.findings(_parsed(spark, sf_dir)).where(F.col("rule_id").isin(*_SAID))
    patterns = {"SCAN-005": "on (\\S+) returns", "MEM-001": "sort by (\\S+) used", "EST-001": "^(\\d+) rows", "JOIN-002": "took (\\d+) batches", "SKEW-001": "where (\\d+) were", "TYPE-001": "[.](\\S+) in"}
    told = F
    for rule_id, pattern in patterns.items():
        told = told.when(F.col("rule_id") == rule_id, F.regexp_extract("detail", pattern, 1))
    e = F.col("evidence")[0]
    return f.select("plan_id", "ord", "rule_id", told.alias("told"), "relation", e["rows"].alias("rows"), e["estimated"].alias("estimated"))
