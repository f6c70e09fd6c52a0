"""Diagnostic rules and structural anti-patterns as predicates over node rows; all rules look at a node in one pass.

A node row has the node's own columns and, thinned out to what rules ask of other nodes, kids (its children), sub (all below it) and above (its
ancestors, nearest first), so a rule is one Boolean expression, and a node's findings are the bits of one number. Rules about a whole plan look at
the plan's row. What a finding says is written only for nodes with findings. Nothing joins; the only exchange is the parser's.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansmith.plans.parser import first, nodes


@dataclass(frozen=True)
class Config:
    """Thresholds; a rule reads what it needs."""

    large_table_rows: float = 10_000
    memory_threshold_kb: float = 102_400
    estimation_skew_factor: float = 100
    nested_loop_inner_rows: float = 10_000
    max_plan_depth: int = 10
    disabled: tuple[str, ...] = ()

    def literals(self) -> dict[str, str]:
        return {f.name: f"{float(getattr(self, f.name))!r}D" for f in fields(self) if f.name != "disabled"}


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    predicate: str
    advice: str
    whole_plan: bool = False  #: comes after the rules about single nodes
    of_plan: bool = False  #: looks at the plan's row


SEVERITIES = {"Critical": 0, "Warning": 1, "Info": 2}


def _in(column: str, *values: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_SORT = ("Sort", "VectorSort", "GroupSort")
_STREAM = _in("{x}.node_type", "Streaming", "VectorStreaming")
#: Ancestors that read all of a scan anyway; scans below which a table is looked for (fixed values).
_WHOLE = ["HashJoin", "Hash", "VectorHashJoin", "Sort", "VectorSort", "HashAggregate", "GroupAggregate", "Unique", "MergeJoin", "Materialize"]
_SCANS = ["SeqScan", "IndexScan", "IndexOnlyScan", "BitmapHeapScan", "CStoreScan", "CStoreIndexScan", "PartitionedSeqScan", "PartitionedIndexScan", "PartitionedBitmapHeapScan"]
_SUBPLAN = "exists({x}, p -> p.value LIKE '%SubPlan%')"
_MISS = "plan_rows > 0 AND run.rows > 0 AND run.rows / plan_rows > {estimation_skew_factor}"
#: A quote within patterns within SQL texts.
_Q = r"\\x27"
#: The identifier that a comparison's left side ends with, its type left out.
_ENDS = r"nullif(regexp_extract(rtrim(') ', regexp_replace({x}, '::[a-z ]+([(][0-9, ]*[)])?[) ]*$', '')), '(^|[ (,])([A-Za-z_][A-Za-z_0-9]*)$', 2), '')"
_SIDES = "split(filter, ' *= *')"
#: The column of a filter's first comparison with a literal: of what stands before and behind each equals sign, the first pair that fits.
COLUMN = f"""get(filter(transform(sequence(1, greatest(size({_SIDES}) - 1, 1)), i -> if(get({_SIDES}, i) RLIKE '^({_Q}|[0-9])', {_ENDS.format(x=f"get({_SIDES}, i - 1)")}, NULL)), c -> c IS NOT NULL), 0)"""
_TYPES = (
    "text numeric int int2 int4 int8 bigint smallint integer varchar char bpchar float float4 float8 double precision real bool boolean date timestamp timestamptz time timetz interval name bytea uuid json jsonb clob blob raw"
)  # fixed values
_CAST = "lower(try_element_at(regexp_extract_all({side}, '::([a-zA-Z_][a-zA-Z0-9_]*)', 1), -1))"
_LEFT, _RIGHT = _CAST.format(side="substring_index(filter, '=', 1)"), _CAST.format(side="substr(filter, instr(filter, '=') + 1)")
_NUMERIC = f"try_cast(regexp_extract(filter, concat('(?i)', filter_column, '[)]* *= *{_Q}([^{_Q}]+){_Q}'), 1) AS double) IS NOT NULL"
_TO_NUMERIC = f"filter RLIKE concat('(?i)[(] *', filter_column, ' *[)] *:: *numeric *= *{_Q}([^{_Q}]+){_Q}')"
#: The first child of a node's first child.
_GRAND = "get(filter(sub, d -> d.parent = get(kids, 0).ord), 0)"
_TARGET = f"coalesce(relation, get(kids, 0).relation, {_GRAND}.relation)"
_PARTS = "regexp_extract(partitions, '^ *([0-9]+)[.][.]([0-9]+) *$', {n})"
_SCANNED = f"(cast({_PARTS.format(n=2)} AS double) - cast({_PARTS.format(n=1)} AS double) + 1)"
_FUNCTION = "filter RLIKE 'date_part|EXTRACT|to_char|to_date|to_timestamp'"
_JOIN_REMOVED = f"try_cast(trim({first('Rows Removed by Join Filter')}) AS double)"
_HEAP = f"try_cast(trim({first('Heap Fetches')}) AS double)"

#: In the order in which they report.
RULES = [
    Rule("SCAN-001", "Warning", "ScanEfficiency", f"{_in('node_type', 'SeqScan', 'PartitionedSeqScan')} AND filter IS NULL AND NOT exists(above, a -> {_in('a.node_type', *_WHOLE)}) AND plan_rows > {{large_table_rows}}", "Filter the scan or read fewer columns; an index helps selective reads."),
    Rule("SCAN-004", "Warning", "ScanEfficiency", f"{_in('node_type', 'SeqScan', 'PartitionedSeqScan', 'CStoreScan', 'BitmapHeapScan', 'PartitionedBitmapHeapScan')} AND NOT {_SUBPLAN.format(x='props')} AND filter IS NOT NULL AND plan_rows > 0 AND run IS NOT NULL AND (run.rows > 0 AND plan_rows / run.rows > 10 OR coalesce(removed, 0) > 500)", "Most rows read are thrown away; index the filter's columns."),
    Rule("SCAN-005", "Warning", "ScanEfficiency", f"{_in('node_type', 'IndexScan', 'IndexOnlyScan', 'PartitionedIndexScan', 'CStoreIndexScan')} AND run.rows * run.loops > {{large_table_rows}}", "The index returns a large part of the table; a full scan may be cheaper."),
    Rule("JOIN-001", "Critical", "JoinStrategy", "node_type = 'NestedLoop' AND array_max(transform(kids, k -> k.rows * k.loops)) > {nested_loop_inner_rows}", "The inner side is read again and again; a hash join or an index on its key helps."),
    Rule("JOIN-002", "Critical", "JoinStrategy", "node_type = 'Hash' AND hash_batches > 1", "The hash table didn't fit; give it more memory."),
    Rule("JOIN-003", "Warning", "JoinStrategy", f"{_in('node_type', 'HashJoin', 'MergeJoin')} AND exists(props, p -> p.label = 'Join Filter') AND {_JOIN_REMOVED} > 10000", "Rows are joined to be dropped; move the condition into the join's key."),
    Rule("MEM-001", "Critical", "MemoryUsage", f"{_in('node_type', *_SORT)} AND sort_method LIKE '%external%'", "The sort went to disk; give it more memory or sort fewer rows."),
    Rule("MEM-004", "Warning", "MemoryUsage", "coalesce(peak_memory, array_max(transform(ns, n -> n.peak_kb)), 0) > {memory_threshold_kb}", "The plan's peak memory is high; look at its largest node.", True, True),
    Rule("SORT-003", "Warning", "SortEfficiency", f"{_in('node_type', *_SORT)} AND exists(sub, d -> {_in('d.node_type', *_SORT)})", "One of two sorts is enough."),
    Rule("NET-001", "Critical", "NetworkOverhead", f"node_type = 'Streaming' AND {_in('streaming', 'Broadcast', 'SplitBroadcast', 'PartRedistributePartBroadcast')} AND run.rows > {{large_table_rows}}", "Too many rows for a broadcast; redistribute by the key."),
    Rule("EST-001", "Critical", "CostMisestimation", _MISS, "Rows are far from the estimate; collect statistics."),
    Rule("EST-004", "Critical", "CostMisestimation", f"node_type = 'NestedLoop' AND {_MISS}", "A nested loop was chosen on a wrong estimate; collect statistics."),
    Rule("PUSH-001", "Critical", "PushdownFailure", f"node_type = 'Streaming' AND {_in('streaming', 'Redistribute', 'Broadcast')}", "The query isn't sent to the data nodes as a whole; look for what below keeps it."),
    Rule("PUSH-002", "Critical", "PushdownFailure", f"{_STREAM.replace('{x}.', '')} AND exists(sub, d -> {_STREAM.replace('{x}', 'd')})", "Rows move more than once; align distribution keys."),
    Rule("TYPE-001", "Critical", "TypeMismatch", f"node_type = 'SeqScan' AND filter_column IS NOT NULL AND NOT array_contains(split('{_TYPES}', ' '), lower(filter_column)) AND NOT coalesce({_LEFT} = {_RIGHT}, false) AND ({_NUMERIC} OR {_TO_NUMERIC}) AND removed > 10 AND removed / (removed + coalesce(run.rows, 0)) > 0.5", "Compare the column with a value of its own type."),
    Rule("TYPE-004", "Warning", "TypeMismatch", f"try_element_at(filter(props, p -> p.label IN ('Filter', 'Index Cond') AND p.value RLIKE '(LIKE|like|~~) \\'%'), 1) IS NOT NULL", "A leading wildcard can't use an index."),
    Rule("VEC-001", "Warning", "Vectorization", f"size(filter(ns, n -> {_in('n.node_type', 'RowAdapter', 'VectorAdapter')})) >= 2", "Row and vector engines take turns; keep to one.", True, True),
    Rule("GEN-001", "Info", "General", "array_max(transform(ns, n -> n.depth)) > {max_plan_depth}", "The plan is deep; break the query up.", True, True),
    Rule("SUBQ-001", "Warning", "SubqueryStructure", f"{_in('node_type', 'SubqueryScan', 'VectorSubqueryScan')} OR ({_SUBPLAN.format(x='props')} AND NOT exists(above, a -> {_in('a.node_type', 'SubqueryScan', 'VectorSubqueryScan')}))", "Write the subquery as a join."),
    Rule("REW-001", "Warning", "SubqueryStructure", "filter LIKE '%IN (%' AND length(filter) - length(replace(filter, ',', '')) > 10", "Join with a table of values in place of a long list."),
    Rule("SUBQ-006", "Warning", "SubqueryStructure", f"{_in('node_type', 'Update', 'ModifyTable', 'VectorUpdate')} AND {_TARGET} IS NOT NULL AND ({_SUBPLAN.format(x='props')} OR exists(sub, d -> d.subplan)) AND exists(sub, d -> {_in('d.node_type', *_SCANS)} AND d.relation = {_TARGET})", "Update from one aggregate in place of a subquery for every row."),
    Rule("AGG-001", "Warning", "MemoryUsage", "node_type = 'GroupAggregate' AND run.rows > 10000 AND exists(kids, k -> k.node_type = 'Sort')", "A hash aggregate needs no sort."),
    Rule("AGG-002", "Critical", "MemoryUsage", "node_type = 'HashAggregate' AND hash_batches > 1", "The aggregate went to disk; give it more memory."),
    Rule("PART-001", "Warning", "DistributionIssue", f"{_in('node_type', 'PartitionedSeqScan', 'PartitionedCStoreScan')} AND partitions IS NOT NULL AND CASE WHEN {_PARTS.format(n=1)} <> '' THEN (coalesce({_FUNCTION}, false) AND cast({_PARTS.format(n=1)} AS double) <= 1 AND {_SCANNED} >= cast({_PARTS.format(n=2)} AS double)) OR {_SCANNED} > 10 ELSE coalesce({_FUNCTION}, false) END", "Compare the partition key itself, not a function of it."),
    Rule("STATS-001", "Warning", "CostMisestimation", "node_type = 'SeqScan' AND plan_rows = 10 AND run.rows > 1000", "The estimate is a default; collect statistics."),
    Rule("DIST-001", "Warning", "DistributionIssue", "node_type = 'Streaming' AND streaming = 'Redistribute' AND run.rows > 10000", "Many rows move; choose the join key as distribution key."),
    Rule("SKEW-001", "Critical", "DistributionIssue", "node_type = 'Streaming' AND streaming = 'Redistribute' AND run.rows > 100000 AND plan_rows > 0 AND run.rows / plan_rows > 5", "Rows are unevenly spread; choose another distribution key.", True),
]

_LOOP, _INDEX = _in("{x}", "NestedLoop", "VectorNestLoop"), ("IndexScan", "IndexOnlyScan", "PartitionedIndexScan", "PartitionedIndexOnlyScan")
_AMPLIFIED = f"""exists(kids, k -> {_in('k.node_type', *_INDEX)} AND k.sifts)"""
_GATHER = "exists(above, a -> a.node_type IN ('Streaming', 'VectorStreaming') AND a.streaming = 'Gather')"
_SORTED_KID = "try_element_at(filter(kids, k -> k.node_type IN ('Sort', 'VectorSort') AND (k.rows IS NULL OR k.rows >= 100000)), 1).rows >= 100000"
PATTERNS = [
    Rule("ANTI-005", "Warning", "SubqueryStructure", f"{_in('node_type', 'Materialize', 'VectorMaterialize')} AND {_in('get(kids, 0).node_type', 'Materialize', 'VectorMaterialize')} AND {_LOOP.replace('{x}', _GRAND + '.node_type')}", "One of two materialised steps is enough.", True),
    Rule("ANTI-003", "Warning", "ScanEfficiency", f"{_LOOP.replace('{x}', 'node_type')} AND run.rows >= 10000 AND {_AMPLIFIED}", "Put the filter into the index's condition.", True),
    Rule("ANTI-007", "Warning", "SortEfficiency", f"{_in('node_type', 'Sort', 'VectorSort')} AND run.rows >= 100000 AND {_GATHER}", "Sort before the gather.", True),
    Rule("ANTI-008", "Warning", "JoinStrategy", f"{_LOOP.replace('{x}', 'node_type')} AND run.rows >= 100000 AND {_SORTED_KID}", "A merge join uses the order; a nested loop doesn't.", True),
    Rule("ANTI-009", "Warning", "JoinStrategy", f"{_in('node_type', 'HashJoin', 'VectorHashJoin', 'VectorSonicHashJoin')} AND size(kids) >= 2 AND get(kids, 1).rows / greatest(get(kids, 0).rows, 1D) > 5 AND get(kids, 0).rows IS NOT NULL", "The larger side is hashed; swap the sides.", True),
    Rule("ANTI-010", "Warning", "General", f"{_in('node_type', 'Unique', 'VectorUnique')} AND exists(above, a -> {_in('a.node_type', 'Unique', 'VectorUnique')})", "One DISTINCT is enough.", True),
    Rule("ANTI-011", "Warning", "ScanEfficiency", f"{_in('node_type', 'IndexScan', 'PartitionedIndexScan', 'BitmapIndexScan', 'CStoreIndexScan')} AND {_HEAP} > 10000", "Vacuum, or let the index cover the query.", True),
    Rule("ANTI-012", "Warning", "NetworkOverhead", f"{_in('node_type', 'Aggregate', 'GroupAggregate', 'HashAggregate', 'VectorAggregate', 'VectorHashAggregate', 'VectorSonicHashAggregate', 'VectorSortAggregate')} AND size(filter(above, a -> {_STREAM.replace('{x}', 'a')})) > 1", "Aggregate after the rows have moved once.", True),
]
ALL = RULES + PATTERNS


#: What rules ask of the nodes around one.
_TOLD = (
    "n.node_type AS node_type", "n.relation AS relation", "n.streaming AS streaming", "n.sort_key AS sort_key", "n.line_no AS line_no", "n.run.rows AS rows", "n.run.loops AS loops",
    f"{_SUBPLAN.format(x='n.props')} AS subplan", "coalesce(n.filter IS NOT NULL AND n.removed > 0 AND exists(n.props, p -> p.label = 'Index Cond'), false) AS sifts",
)


def _mask(rules: list[tuple[int, Rule]], config: Config):
    """One bit for each rule that holds."""
    bits = [F.when(F.expr(r.predicate.format(**config.literals())), F.lit(1 << i).cast("long")).otherwise(0) for i, r in rules] or [F.lit(0).cast("long")]
    while len(bits) > 1:  # a flat tree of sums
        bits = [bits[k] + bits[k + 1] if k + 1 < len(bits) else bits[k] for k in range(0, len(bits), 2)]
    return bits[0]


def _live(config: Config, of_plan: bool) -> list[tuple[int, Rule]]:
    return [(i, r) for i, r in enumerate(ALL) if r.id not in config.disabled and r.of_plan == of_plan]


def masks(parsed: DataFrame, config: Config = Config(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """The rows of nodes (and what ``keep`` names of their plans) with mask, a bit for each rule about nodes that holds, and plan_mask, the same for rules about the plan."""
    p = parsed.withColumn("plan_mask", _mask(_live(config, True), config))
    wide = nodes(p, *_TOLD, keep=("plan_mask", *keep)).withColumn("filter_column", F.expr(COLUMN))
    # generated, not projected: the optimizer would write the whole expression out wherever a filter asks for the mask
    return wide.select("*", F.explode(F.array(_mask(_live(config, False), config))).alias("mask"))


def _rule(rule_no):
    """The rule's own fields by its number."""
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in (("rule_id", r.id), ("severity", r.severity), ("severity_rank", SEVERITIES[r.severity]), ("category", r.category), ("phase", int(r.whole_plan)), ("suggestion", r.advice))]) for r in ALL]
    return F.array(*rows)[rule_no]


def findings(parsed: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """A row a finding: plan_id, phase, ord, rule, severity, node, suggestion, and what it says: detail and detail_zh (the same in English and
    Chinese), table, columns, evidence. Rules about nodes come first, in order of nodes and rules; the order is that of ``ordered``."""
    from plansmith.plans import messages

    plan_rules = [i for i, _ in _live(config, True)]
    p = parsed.withColumn("own_mask", _mask(_live(config, True), config)).withColumn("of_plan", messages.of_plan(plan_rules, "own_mask"))
    numbers = ", ".join(str(i) for i, _ in _live(config, False)) or "0"
    of_nodes = f"transform(filter(array({numbers}), i -> (shiftright(mask, i) & 1) = 1), i -> cast(struct(i, NULL, NULL, NULL) AS {messages.FOUND}))"
    wide = masks(p, config, keep=("of_plan",)).where("mask <> 0 or ord = 0 and size(of_plan) > 0")
    found = wide.select("*", F.explode_outer(F.expr(f"concat({of_nodes}, if(ord = 0, of_plan, slice(of_plan, 1, 0)))")).alias("f")).where("f IS NOT NULL").withColumn("rule_no", F.col("f.rule_no"))
    return messages.said(found).withColumn("r", _rule(F.col("rule_no"))).select("plan_id", "ord", "node_line", "node_type", "relation", "rule_no", "r.*", *messages.SAID)


def hints(found: DataFrame) -> DataFrame:
    """plan_id, rule_id, table, columns, severity in lower case, detail of findings: what a rewriter is told."""
    return found.select("plan_id", "rule_id", "table", "columns", F.lower("severity").alias("severity"), "detail")


def _order():
    # rules about single nodes go node by node, the others rule by rule
    return [F.col("severity_rank"), F.col("phase"), F.when(F.col("phase") == 0, F.col("ord")).otherwise(F.col("rule_no")), F.when(F.col("phase") == 0, F.col("rule_no")).otherwise(F.coalesce("ord", F.lit(-1)))]


def ordered(found: DataFrame) -> DataFrame:
    """Adds place: each finding's place in its plan's report, from 1."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy(*_order())))


def one_a_node(found: DataFrame) -> DataFrame:
    """The first finding of each node, and all that aren't of one."""
    n = F.row_number().over(Window.partitionBy("plan_id", "node_line").orderBy(*_order()))
    return found.withColumn("__n", n).where("node_line is null or __n = 1").drop("__n")
