"""The words of plans: node names, their categories, movement types, join types, summary labels."""

from __future__ import annotations

# Node names by category, as plans print them. A variant's name is the text without blanks, but for VARIANTS.
SCANS = [
    "Seq Scan", "Partitioned Seq Scan", "Sample Scan", "Index Scan", "Partitioned Index Scan", "Index Only Scan", "Partitioned Index Only Scan", "Bitmap Index Scan",
    "Partitioned Bitmap Index Scan", "Bitmap Heap Scan", "Partitioned Bitmap Heap Scan", "Tid Scan", "Tid Range Scan", "Subquery Scan", "Function Scan", "Values Scan", "CTE Scan",
    "WorkTable Scan", "Foreign Scan", "Partitioned Foreign Scan", "CStore Scan", "Partitioned CStore Scan", "TsStore Scan", "ANN Index Scan", "CStore Index Scan",
    "CStore Index Ctid Scan", "CStore Index Heap Scan", "ImCStore Scan", "Vector Subquery Scan", "Vector Foreign Scan", "Data Node Scan",
]
JOINS = ["Nested Loop", "Hash Join", "Merge Join", "Vector Nest Loop", "Vector Hash Join", "Vector Sonic Hash Join", "Vector Merge Join", "Vector Asof Join"]
AGGREGATES = ["Aggregate", "Group Aggregate", "Hash Aggregate", "HashAggregate", "Vector Aggregate", "Vector Hash Aggregate", "Vector Sonic Hash Aggregate", "Vector Sort Aggregate", "Group", "Vector Group", "Dummy HashAggregate"]
SORTS = ["Sort", "Group Sort", "Vector Sort"]
SET_OPERATIONS = [
    "SetOp", "Hash SetOp", "HashSetOp", "Vector SetOp", "Vector Hash SetOp", "Vector HashSetOp", "Append", "Vector Append", "Merge Append", "Recursive Union", "BitmapAnd", "BitmapOr",
    "CStore Index And", "CStore Index Or",
]
CHANGES = ["Insert", "Update", "Delete", "Merge", "Replace", "Vector Insert", "Vector Update", "Vector Delete", "Vector Merge"]
OTHERS = [
    "WindowAgg", "Vector WindowAgg", "Unique", "Vector Unique", "Result", "Vector Result", "ProjectSet", "Hash", "Materialize", "Vector Materialize", "Limit", "Vector Limit", "LockRows",
    "Partition Iterator", "Vector Partition Iterator", "Row Adapter", "Vector Adapter", "StartWith Op", "Remote Subplan Scan", "ModifyTable", "Gather", "Gather Merge",
]
VARIANTS = {"CTE Scan": "CteScan", "ANN Index Scan": "AnnIndexScan", "StartWith Op": "StartWithOp", "HashSetOp": "HashSetOp", "Vector HashSetOp": "VectorHashSetOp"}
#: Recognised as nodes, but of no known variant (fixed values).
UNKNOWN_NODES = ["Partitioned Tid Scan", "Partial Hash Aggregate", "Vector Merge Append", "Vec Result", "Remote Query", "Merge Into"]
# Kinds of movement as plans print them.
STREAMING = {
    "GATHER": "Gather", "REDISTRIBUTE": "Redistribute", "BROADCAST": "Broadcast", "LOCAL REDISTRIBUTE": "LocalRedistribute", "LOCAL BROADCAST": "LocalBroadcast", "LOCAL GATHER": "LocalGather",
    "LOCAL ROUNDROBIN": "LocalRoundrobin", "SPLIT REDISTRIBUTE": "SplitRedistribute", "SPLIT BROADCAST": "SplitBroadcast", "RANGE REDISTRIBUTE": "RangeRedistribute",
    "LIST REDISTRIBUTE": "ListRedistribute", "HYBRID": "Hybrid", "PART REDISTRIBUTE PART BROADCAST": "PartRedistributePartBroadcast",
    "PART REDISTRIBUTE PART ROUNDROBIN": "PartRedistributePartRoundrobin", "PART REDISTRIBUTE PART LOCAL": "PartRedistributePartLocal", "PART LOCAL PART BROADCAST": "PartLocalPartBroadcast",
}
#: In the order in which they are looked for (fixed values).
JOIN_TYPES = ["Left Anti Full", "Right Anti Full", "Left Anti Semi Not In", "Left", "Right", "Full", "Inner", "Semi", "Anti", "Right Semi", "Right Anti"]
#: Labels of summary lines (fixed values).
SUMMARY_LABELS = ["Total runtime", "Peak Memory", "Planner runtime", "Plan size", "Query Id", "Executor Start", "Executor Run", "Executor End", "Total Network"]

CATEGORIES = {"Scan": SCANS, "Join": JOINS, "Aggregate": AGGREGATES, "Sort": SORTS, "SetOp": SET_OPERATIONS, "Dml": CHANGES, "Other": OTHERS}


def variant(text: str) -> str:
    return VARIANTS.get(text, text.replace(" ", ""))


def variants() -> dict[str, str]:
    """Printed name to variant."""
    return {t: variant(t) for names in CATEGORIES.values() for t in names}


def categories() -> dict[str, str]:
    """Variant to category; movement is Streaming, anything else Other."""
    return {variant(t): c for c, names in CATEGORIES.items() for t in names} | {"Streaming": "Streaming", "VectorStreaming": "Streaming"}
