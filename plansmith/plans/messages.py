"""What findings say: a sentence with the node's figures in English and in Chinese, the table, the columns and the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _whole(x: str) -> str:
    return f"coalesce(cast(cast({x} AS bigint) AS string), '?')"


_ROWS, _PLANNED, _REMOVED = _whole("run.rows"), _whole("plan_rows"), _whole("removed")
#: The table a node is about: its own, or that of the first node below it that has one.
_TABLE = "coalesce(relation, get(filter(sub, d -> d.relation IS NOT NULL), 0).relation)"
_ON = f"coalesce({_TABLE}, '?')"
_SORTS = "filter(sub, d -> d.node_type IN ('Sort', 'VectorSort', 'GroupSort'))"
_STREAMS = "filter(sub, d -> d.node_type IN ('Streaming', 'VectorStreaming'))"
_WORK = _whole("array_max(transform(kids, k -> k.rows * k.loops))")
_ALL_WORK = _whole("aggregate(kids, 0D, (t, k) -> t + coalesce(k.rows * k.loops, 0D))")
_FACTOR = "format_number(run.rows / plan_rows, 1)"
_BLOCKED = "array_join(array_distinct(filter(transform(concat(array(named_struct('t', node_type, 'p', false)), transform(sub, d -> named_struct('t', d.node_type, 'p', d.subplan))), d -> if(d.t = 'SubqueryScan' OR d.t = 'Result' AND d.p, d.t, NULL)), t -> t IS NOT NULL)), ', ')"
_JOIN_REMOVED = "trim(get(filter(props, p -> p.label = 'Rows Removed by Join Filter'), 0).value)"
_HEAP = "trim(get(filter(props, p -> p.label = 'Heap Fetches'), 0).value)"
_LIKE = "get(filter(props, p -> p.label IN ('Filter', 'Index Cond') AND p.value RLIKE '(LIKE|like|~~) \\'%'), 0).value"

#: By rule: English and Chinese sentence, and the SQL expressions of the places (%s).
SENTENCES: dict[str, tuple] = {
    "SCAN-001": ("Seq Scan reads all of %s: about %s rows, without a Filter", "顺序扫描读取整个表 %s：约 %s 行，没有过滤条件", _ON, _PLANNED),
    "SCAN-004": ("Filter on %s keeps %s rows and removes %s: %s", "表 %s 的过滤条件保留 %s 行，丢弃 %s 行：%s", _ON, _ROWS, _REMOVED, "filter"),
    "SCAN-005": ("the index scan on %s returns %s rows in %s loops", "表 %s 的索引扫描返回 %s 行，循环 %s 次", _ON, _ROWS, _whole("run.loops")),
    "JOIN-001": ("the inner side of the nested loop reads %s rows over all loops", "嵌套循环的内侧在所有循环中共读取 %s 行", _WORK),
    "JOIN-002": ("the hash table of %s took %s batches", "表 %s 的哈希表使用了 %s 个批次", _ON, _whole("hash_batches")),
    "JOIN-003": ("the Join Filter removes %s rows after the join", "连接后的过滤条件丢弃 %s 行", f"coalesce({_JOIN_REMOVED}, '?')"),
    "MEM-001": ("the sort by %s used disk: %s", "按 %s 的排序使用了磁盘：%s", "coalesce(sort_key, '?')", "sort_method"),
    "SORT-003": ("Sort by %s stands over %s other Sort nodes, the first by %s: %s", "按 %s 的排序之下还有 %s 个排序，第一个按 %s：%s", "coalesce(sort_key, '?')", f"cast(size({_SORTS}) AS string)", f"coalesce(get({_SORTS}, 0).sort_key, '?')", f"if(sort_key <=> get({_SORTS}, 0).sort_key, 'duplicate', 'redundant')"),
    "NET-001": ("%s sends %s rows of %s to all nodes", "%s 将 %s 行（表 %s）发送到所有节点", "streaming", _ROWS, _ON),
    "EST-001": ("%s rows where %s were estimated, %s times as many", "实际 %s 行，估计 %s 行，相差 %s 倍", _ROWS, _PLANNED, _FACTOR),
    "EST-004": ("the nested loop met %s rows where %s were estimated; its children read %s", "嵌套循环实际 %s 行，估计 %s 行；子节点共读取 %s 行", _ROWS, _PLANNED, _ALL_WORK),
    "PUSH-001": ("Streaming %s moves rows, so the query was not pushed down whole; in its way: %s", "存在 %s 数据流，查询未能整体下推；原因：%s", "streaming", f"coalesce(nullif({_BLOCKED}, ''), if(filter RLIKE 'now[(]|random[(]|nextval', 'volatile function', 'unknown'))"),
    "PUSH-002": ("%s layers of Streaming lie one over the other: %s", "%s 层数据流相互叠加：%s", f"cast(size({_STREAMS}) + 1 AS string)", f"array_join(concat(array(streaming), transform({_STREAMS}, d -> d.streaming)), ' > ')"),
    "TYPE-001": ("implicit type cast of %s.%s in %s: %s rows removed", "%s.%s 在 %s 中发生隐式类型转换：丢弃 %s 行", _ON, "filter_column", "filter", _REMOVED),
    "TYPE-004": ("LIKE with a leading wildcard on %s: %s", "表 %s 上以通配符开头的 LIKE：%s", _ON, _LIKE),
    "SUBQ-001": ("the subquery on %s was not pulled up", "表 %s 上的子查询未被提升", _ON),
    "REW-001": ("%s values in the IN list of %s", "IN 列表中有 %s 个值（表 %s）", "cast(length(filter) - length(replace(filter, ',', '')) + 1 AS string)", _ON),
    "SUBQ-006": ("the update of %s reads %s again in a SubPlan for every row%s", "对 %s 的更新在子计划中对每一行再次读取 %s%s", _ON, _ON, f"if(exists(sub, d -> d.node_type IN ('Streaming', 'VectorStreaming')), ', through Streaming', '')"),
    "AGG-001": ("a group aggregate sorts for %s groups", "分组聚合为 %s 个分组进行了排序", _ROWS),
    "AGG-002": ("the hash aggregate took %s batches", "哈希聚合使用了 %s 个批次", _whole("hash_batches")),
    "PART-001": ("%s reads partitions %s: %s", "%s 读取分区 %s：%s", _ON, "partitions", "coalesce(filter, '')"),
    "STATS-001": ("%s rows of %s where the default of 10 was estimated", "实际 %s 行（表 %s），估计为默认的 10 行", _ROWS, _ON),
    "DIST-001": ("%s rows of %s are redistributed", "%s 行（表 %s）被重分布", _ROWS, _ON),
    "SKEW-001": ("%s rows are redistributed where %s were estimated", "重分布实际 %s 行，估计 %s 行", _ROWS, _PLANNED),
    "ANTI-005": ("a materialised step stands on another one, over a nested loop", "物化步骤叠加在另一个物化步骤上，其下为嵌套循环"),
    "ANTI-003": ("the nested loop of %s rows filters what an index scan of %s returns", "%s 行的嵌套循环过滤索引扫描（表 %s）的结果", _ROWS, _ON),
    "ANTI-007": ("%s rows are sorted below a gather", "聚集之下对 %s 行排序", _ROWS),
    "ANTI-008": ("the nested loop of %s rows reads a sorted side", "%s 行的嵌套循环读取已排序的一侧", _ROWS),
    "ANTI-009": ("the hashed side has %s rows, the other %s", "哈希一侧有 %s 行，另一侧 %s 行", _whole("get(kids, 1).rows"), _whole("get(kids, 0).rows")),
    "ANTI-010": ("a DISTINCT of %s rows stands below another", "%s 行的去重位于另一个去重之下", _ROWS),
    "ANTI-011": ("the index scan on %s fetched %s rows from the table", "表 %s 的索引扫描回表 %s 次", _ON, f"coalesce({_HEAP}, '?')"),
    "ANTI-012": ("an aggregate stands below %s Streaming nodes", "聚合位于 %s 个数据流节点之下", "cast(size(filter(above, a -> a.node_type IN ('Streaming', 'VectorStreaming'))) AS string)"),
}
#: The same of rules about a whole plan, over the plan's row.
_ADAPTERS = "filter(ns, n -> n.node_type IN ('RowAdapter', 'VectorAdapter'))"
_PEAK = "coalesce(peak_memory, array_max(transform(ns, n -> n.peak_kb)))"
_LARGEST = "get(filter(ns, n -> n.peak_kb = array_max(transform(ns, m -> m.peak_kb))), 0)"
OF_PLANS: dict[str, tuple] = {
    "MEM-004": ("Peak memory of %s kB, the largest node is %s", "峰值内存 %s kB，最大的节点为 %s", _whole(_PEAK), f"coalesce({_LARGEST}.node_type, '?')"),
    "VEC-001": ("%s Adapter nodes: %s", "%s 个适配器节点：%s", f"cast(size({_ADAPTERS}) AS string)", f"array_join(transform({_ADAPTERS}, n -> n.node_type), ', ')"),
    "GEN-001": ("the plan is %s nodes deep", "计划深度为 %s 层", "cast(array_max(transform(ns, n -> n.depth)) AS string)"),
}
SAID = ["detail", "detail_zh", "table", "columns", "evidence"]
#: Columns of a filter: identifiers before comparisons.
_COLUMNS = "array_distinct(regexp_extract_all(coalesce(filter, ''), '([A-Za-z_][A-Za-z_0-9]*)[)]*(?:::[a-z ]+)?[)]* *(?:=|<|>|~~|!~~|IS |IN )', 1))"
_OF_COLUMNS = {"SCAN-004", "TYPE-001", "TYPE-004", "REW-001", "PART-001"}
_EVIDENCE = "struct<pattern: string, confidence: double, line: int, node_type: string, rows: double, estimated: double, loops: double>"


def _sentence(sentences: dict[str, tuple], lang: int):
    from plansmith.plans.rules import ALL

    out = F
    for i, r in enumerate(ALL):
        if r.id in sentences:
            own = sentences[r.id]
            out = out.when(F.col("rule_no") == i, F.format_string(own[lang], *[F.expr(x) for x in own[2:]]) if own[2:] else F.lit(own[lang]))
    return out


def _rule_id():
    from plansmith.plans.rules import ALL

    return F.array(*[F.lit(r.id) for r in ALL])[F.col("rule_no")]


#: What a finding about a whole plan says; of a finding about a node only the rule's number is set until ``said`` fills it in.
FOUND = f"struct<rule_no: int, detail: string, detail_zh: string, evidence: array<{_EVIDENCE}>>"


def of_plan(numbers: list[int], mask: str):
    """An array of FOUND for the bits of a plan's mask, over the plan's row."""
    from plansmith.plans.rules import ALL

    adapters = F.expr(f"transform({_ADAPTERS}, n -> struct('VEC-001', 1D, n.line_no, n.node_type, n.run.rows, n.plan_rows, n.run.loops))").cast(f"array<{_EVIDENCE}>")
    none = F.expr(f"cast(array() AS array<{_EVIDENCE}>)")
    made = []
    for i in numbers:
        en, zh, *args = OF_PLANS[ALL[i].id]
        said_ = [F.format_string(x, *[F.expr(a) for a in args]) for x in (en, zh)]
        row = F.struct(F.lit(i).alias("rule_no"), said_[0].alias("detail"), said_[1].alias("detail_zh"), (adapters if ALL[i].id == "VEC-001" else none).alias("evidence"))
        made.append(F.when(F.col(mask).bitwiseAND(F.lit(1 << i).cast("long")) != 0, row.cast(FOUND)))
    return F.filter(F.array(*made), lambda x: x.isNotNull()) if made else F.expr(f"cast(array() AS array<{FOUND}>)")


def said(found: DataFrame) -> DataFrame:
    """Rows of nodes with a finding f (FOUND): what it says. Findings about whole plans have no node."""
    whole = F.col("f.detail").isNotNull()
    own = lambda c: F.when(~whole, c)
    none = F.expr("cast(array() AS array<string>)")
    columns = F.when(whole, none).when(_rule_id() == "TYPE-001", F.array("filter_column")).when(_rule_id().isin(*_OF_COLUMNS), F.expr(_COLUMNS)).otherwise(none)
    evidence = F.struct(_rule_id().alias("pattern"), F.lit(1.0).alias("confidence"), F.col("line_no").alias("line"), F.col("node_type").alias("node_type"), F.col("run.rows").alias("rows"), F.col("plan_rows").alias("estimated"), F.col("run.loops").alias("loops"))
    return found.select(
        "plan_id", own(F.col("ord")).alias("ord"), own(F.col("line_no").cast("int")).alias("node_line"), own(F.col("node_type")).alias("node_type"), own(F.col("relation")).alias("relation"), "rule_no",
        F.coalesce("f.detail", _sentence(SENTENCES, 0)).alias("detail"), F.coalesce("f.detail_zh", _sentence(SENTENCES, 1)).alias("detail_zh"), own(F.expr(_TABLE)).alias("table"), columns.alias("columns"),
        F.coalesce("f.evidence", F.array(evidence).cast(f"array<{_EVIDENCE}>")).alias("evidence"),
    )
