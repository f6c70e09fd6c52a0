"""What is computed over parsed plans: order, statistics, estimate heatmaps, resource waterfalls, sessions, summaries, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree_order(wide: DataFrame) -> DataFrame:
    """child_idx and postorder of each node. Post-order is the line's order plus what is below, less what is above."""
    w = Window.partitionBy("plan_id", "parent").orderBy("ord")
    return wide.select("plan_id", "ord", (F.row_number().over(w) - 1).alias("child_idx"), (F.col("ord") + F.size("sub") - (F.col("depth") - 1)).alias("postorder"))


def plan_stats(parsed: DataFrame) -> DataFrame:
    """nodes, max_depth, max_time and max_rows of each plan, without an exchange of its own."""
    most = lambda of: F.expr(f"greatest(array_max(transform(ns, n -> coalesce({of}, 0D))), 0D)")
    return parsed.select("plan_id", F.size("ns").alias("nodes"), F.expr("array_max(transform(ns, n -> n.depth))").alias("max_depth"), most("n.run.time").alias("max_time"), most("n.run.rows").alias("max_rows"))


#: Limits of a q-error's severity, lowest first (fixed values).
SEVERITIES = [(2, "Negligible"), (5, "Mild"), (10, "Moderate"), (50, "Severe")]
_Q = "if(n.run.executed AND n.plan_rows > 0 AND n.run.rows > 0, greatest(n.plan_rows, n.run.rows) / least(n.plan_rows, n.run.rows), NULL)"


def heatmap(parsed: DataFrame) -> DataFrame:
    """A row a node whose estimate and count of rows are both positive: q_error, direction, severity, path (product from the root), subtree_geo, on
    critical_path.

    subtree_geo is nested: the mean of a node's own value and its children's means, geometrically. Node x adds ln q(x) over the product of 1 +
    children on the way down to it, so a sum over what is below gives it without recursion.
    """
    from plansmith.plans.parser import nodes, widened

    p = widened(parsed, f"coalesce({_Q}, 1D) AS q", f"({_Q}) IS NOT NULL AS counted", "ln(1 + size(filter(ns, k -> k.parent = n.ord))) AS fan")
    p = widened(p, "aggregate(n.ancestors, n.q, (t, a) -> t * ns[a].q) AS path", "n.fan + aggregate(n.ancestors, 0D, (t, a) -> t + ns[a].fan) AS down")
    p = p.withColumn("best", F.expr("transform(ns, n -> array_max(transform(filter(ns, k -> k.parent = n.ord), k -> named_struct('path', if(k.counted, k.path, 1D), 'ord', k.ord))).ord)"))
    w = nodes(p, "n.q AS q", "n.down AS down", keep=("best",))
    above = F.coalesce(F.expr("get(above, 0).down"), F.lit(0.0))
    below = F.expr("aggregate(sub, 0D, (t, d) -> t + ln(d.q) * exp(-d.down))")
    geo = F.exp((F.log("q") * F.exp(-F.col("down")) + below) * F.exp(above))
    ratio = F.col("run.rows") / F.col("plan_rows")
    severity = F.lit("Extreme")
    for limit, name in reversed(SEVERITIES):
        severity = F.when(F.col("q") < limit, name).otherwise(severity)
    best = F.expr("forall(concat(array(named_struct('ord', ord, 'parent', parent)), transform(above, a -> named_struct('ord', a.ord, 'parent', a.parent))), x -> x.parent IS NULL OR x.ord = get(best, x.parent))")
    return w.where("counted").select(
        "plan_id", "ord", F.col("q").alias("q_error"), F.when(ratio > 1.5, "Under").when(ratio < 0.67, "Over").otherwise("Accurate").alias("direction"), severity.alias("severity"),
        "path", geo.alias("subtree_geo"), best.alias("critical_path"),
    )


def heatmap_summary(parsed: DataFrame) -> DataFrame:
    """Of each plan with a counted node: entries, worst q-error, entries of 10 and more, entries of 2 and more."""
    return heatmap(parsed).groupBy("plan_id").agg(F.count("*").alias("entries"), F.max("q_error").alias("worst"), F.count_if(F.col("q_error") >= 10).alias("severe"), F.count_if(F.col("q_error") >= 2).alias("deviating"))


def waterfall(parsed: DataFrame) -> DataFrame:
    """Resources of each node: cpu (its time by its loops, inclusive times as they stand), mem, what is at and below it, percent of the plan, bottleneck."""
    from plansmith.plans.parser import nodes, widened

    cpu = "if(coalesce(n.run.executed, false), n.run.time * n.run.loops, 0D)"
    p = widened(parsed, f"{cpu} AS cpu", "coalesce(n.peak_kb, 0D) AS mem", "coalesce(n.sort_disk IS NOT NULL OR n.hash_batches > 1, false) AS spill")
    p = p.withColumns({"all_cpu": F.expr("aggregate(ns, 0D, (t, n) -> t + n.cpu)"), "most_mem": F.expr("array_max(transform(ns, n -> n.mem))")})
    w = nodes(p, "n.cpu AS cpu", "n.mem AS mem", keep=("all_cpu", "most_mem"))
    cpu_percent = F.when(F.col("all_cpu") > 0, F.col("cpu") / F.col("all_cpu") * 100).otherwise(0.0)
    mem_percent = F.when(F.col("most_mem") > 0, F.col("mem") / F.col("most_mem") * 100).otherwise(0.0)
    out = w.select(
        "plan_id", "ord", "cpu", "mem", "spill", F.expr("cpu + aggregate(sub, 0D, (t, d) -> t + d.cpu)").alias("subtree_cpu"), F.expr("greatest(mem, coalesce(array_max(transform(sub, d -> d.mem)), 0D))").alias("subtree_mem"),
        cpu_percent.alias("cpu_percent"), mem_percent.alias("mem_percent"), (F.col("ord") + F.size("sub") - (F.col("depth") - 1)).alias("postorder"),
    )
    return out.withColumn("bottleneck", (F.col("cpu_percent") >= 20) | (F.col("mem_percent") >= 25) | F.col("spill"))


def top_consumers(water: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k largest nodes of each plan, ties in post-order."""
    w = Window.partitionBy("plan_id").orderBy(F.desc(by), "postorder")
    return water.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("plan_id", "rank", "ord", by)


#: Synthesised suggestions: kind, confidence, condition over the array `ids` of a plan's rules (fixed values).
SUGGESTIONS = [
    ("StatisticsUpdate", 0.85, "size(filter(ids, r -> r LIKE 'EST-%')) >= 2"),
    ("ConfigurationTuning", 0.9, "size(filter(ids, r -> r IN ('MEM-001', 'MEM-004', 'JOIN-002', 'AGG-002'))) >= 2"),
    ("IndexOptimization", 0.8, "exists(ids, r -> r LIKE 'SCAN-%') AND exists(ids, r -> r LIKE 'JOIN-%')"),
    ("DistributionOptimization", 0.75, "exists(ids, r -> r LIKE 'PUSH-%')"),
    ("QueryRewrite", 0.9, "array_contains(ids, 'SUBQ-006')"),
    ("QueryRewrite", 0.85, "size(filter(ids, r -> r LIKE 'TYPE-%')) >= 2"),
    ("ConfigurationTuning", 0.8, "exists(ids, r -> r LIKE 'VEC-%')"),
]


def suggestions(found: DataFrame) -> DataFrame:
    """plan_id, no, kind, confidence: what several findings of a plan say together."""
    ids = found.groupBy("plan_id").agg(F.collect_list("rule_id").alias("ids"))
    made = [F.when(F.expr(c), F.struct(F.lit(i).alias("no"), F.lit(k).alias("kind"), F.lit(x).alias("confidence"))) for i, (k, x, c) in enumerate(SUGGESTIONS)]
    return ids.select("plan_id", F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def summary(parsed: DataFrame, config=None) -> DataFrame:
    """One wide row a plan; a plan without findings has zero of each severity. Findings are counted with their plan, without a join."""
    from plansmith.plans import rules

    config = config or rules.Config()
    streaming = "exists(ns, n -> n.node_type IN ('Streaming', 'VectorStreaming'))"
    own = F.struct(
        F.expr("ns[0].node_type").alias("root_op"), F.expr("coalesce(ns[0].total_cost, 0D)").alias("total_cost"), F.expr("coalesce(total_runtime, ns[0].run.time, 0D)").alias("total_time_ms"),
        F.expr("ns[0].run.rows").alias("actual_rows"), F.expr("ns[0].plan_rows").alias("estimated_rows"), F.expr("ns[0].run.loops").alias("total_loops"), F.size("ns").alias("node_count"),
        F.expr("array_max(transform(ns, n -> n.depth))").alias("plan_depth"), F.expr("array_max(transform(filter(ns, n -> n.plan_rows >= 1 AND n.run IS NOT NULL), n -> n.run.rows / n.plan_rows))").alias("worst_est_ratio"),
        F.expr("nullif(aggregate(ns, 0D, (t, n) -> t + coalesce(try_cast(regexp_replace(n.sort_disk, 'kB$', '') AS double), 0D)), 0D)").alias("spill_kb"),
        F.expr("coalesce(peak_memory, get(filter(ns, n -> n.peak_kb IS NOT NULL), 0).peak_kb)").alias("peak_memory_kb"),
        F.expr(f"if({streaming}, 'NotPushed', 'Local')").alias("pushdown"), F.expr("array_max(transform(ns, n -> n.removed))").alias("max_filter_removed"), F.col("total_network").alias("network_kb"), F.col("planner_runtime").alias("planner_time_ms"),
    )
    nodes = rules.masks(parsed.withColumn("own", own), config, keep=("own",))
    count = lambda name: F.first(F.expr(f"bit_count(plan_mask & {_bits(name)}L)")) + F.sum(F.expr(f"bit_count(mask & {_bits(name)}L)"))
    return nodes.groupBy("plan_id").agg(F.first("own").alias("own"), *[count(s).alias(f"{s.lower()}_count") for s in rules.SEVERITIES]).select("plan_id", "own.*", *[f"{s.lower()}_count" for s in rules.SEVERITIES])


def _bits(severity: str) -> int:
    """The bits of the rules of a severity."""
    from plansmith.plans import rules

    return sum(1 << i for i, r in enumerate(rules.ALL) if r.severity == severity)


#: Labels of the properties that tell plans apart (fixed values).
COMPARED = ["Filter", "Sort Key", "Merge Sort Key", "Index Cond", "Hash Cond", "Join Filter", "Merge Cond", "Group By Key", "Distribute Key"]


#: The same of the corpus's nodes n, in SQL.
SHAPE_SQL = "string_agg(concat_ws('|', node_type, coalesce(streaming, ''), coalesce(relation, ''), coalesce(filter, ''), coalesce(sort_key, ''), CASE WHEN k IN (2, 3) THEN 'i' WHEN k IN (8, 9) THEN 'j' ELSE '' END), chr(10) ORDER BY ord)"


def outline():
    """A plan's nodes with their relations and conditions in order, as one text."""
    labels = ", ".join(f"'{x}'" for x in COMPARED)
    conditions = f"filter(n.props, p -> p.label IN ({labels}))"
    return F.expr(f"array_join(transform(ns, n -> concat_ws('|', n.node_type, coalesce(n.streaming, ''), coalesce(n.relation, ''), array_join(transform({conditions}, p -> concat(p.label, '=', p.value)), ';'))), '\\n')")


def fingerprint(text=None):
    """Equal for plans of the same nodes, relations and conditions in the same order. text: the plan's outline, if it is at hand."""
    return F.sha2(outline() if text is None else text, 256)


def fingerprints(parsed: DataFrame) -> DataFrame:
    """plan_id, fingerprint of each plan."""
    return parsed.select("plan_id", fingerprint().alias("fingerprint"))


def bottlenecks(steps: DataFrame, session: str, runtime: str) -> DataFrame:
    """Adds contribution (percent of the session's time) and bottleneck: Primary over 50, Secondary over mean and two deviations, else None."""
    w = Window.partitionBy(session)
    total, mean, spread = F.sum(runtime).over(w), F.avg(runtime).over(w), F.stddev_pop(runtime).over(w)
    share = F.when(total > 0, F.col(runtime) / total * 100).otherwise(0.0)
    kind = F.when(total <= 0, "None").when(share > 50, "Primary").when((spread > 0) & (F.col(runtime) > mean + 2 * spread), "Secondary").otherwise("None")
    return steps.withColumn("contribution", share).withColumn("bottleneck", kind)


def template_groups(steps: DataFrame, session: str, template: str, runtime: str, *more) -> DataFrame:
    """Templates that a session runs more than once: times, and degradation (longest over mean). more: other aggregates of the same rows."""
    g = steps.groupBy(session, template).agg(F.count("*").alias("runs"), F.sum(runtime).alias("total"), F.min(runtime).alias("least"), F.max(runtime).alias("most"), *more)
    g = g.where("runs > 1").withColumn("mean", F.col("total") / F.col("runs"))
    return g.withColumn("degradation", F.when(F.col("mean") > 0, F.col("most") / F.col("mean")).otherwise(1.0))
