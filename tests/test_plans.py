"""Plans written by hand, with what the rules say about them."""

import random

import pytest
from pyspark.sql import functions as F

from plansmith.plans import analytics, parser, rules

PLANS = {
    "external_sort": "Sort  (cost=5.0..6.0 rows=900 width=8) (actual time=1.0..2.0 rows=900 loops=1)\n  Sort Key: k\n  Sort Method: external merge  Disk: 64kB\n  ->  Seq Scan on ev  (cost=0.0..4.0 rows=900 width=8) (actual time=0.1..0.9 rows=900 loops=1)",
    "large_loop": "Nested Loop  (cost=0.0..9.0 rows=9 width=8) (actual time=0.1..90.0 rows=700 loops=1)\n  ->  Seq Scan on big  (cost=0.0..5.0 rows=40000 width=4) (actual time=0.1..5.0 rows=40000 loops=1)\n  ->  Index Scan using pk on small s  (cost=0.0..1.0 rows=1 width=4) (actual time=0.1..0.2 rows=1 loops=40000)",
    "never": "Limit  (cost=0.0..1.0 rows=1 width=4)\n  ->  Seq Scan on t  (cost=0.0..1.0 rows=5 width=4) (Actual time: never executed)",
    "spill": "Hash Join  (cost=0.0..9.0 rows=9 width=8) (actual rows=9 loops=1)\n  ->  Seq Scan on a  (cost=0.0..1.0 rows=5 width=4) (actual rows=5 loops=1)\n  ->  Hash  (cost=0.0..1.0 rows=5 width=4) (actual rows=5 loops=1)\n        Buckets: 1024  Batches: 6  Memory Usage: 3MB\n        ->  Seq Scan on b  (cost=0.0..1.0 rows=5 width=4) (actual rows=5 loops=1)\nPeak Memory: 430000 KB\nTotal runtime: 12.5 ms",
    "left_join": "Hash Left Join  (cost=0.0..9.0 rows=9 width=8)\n  ->  Vector Streaming(type: LOCAL GATHER)  (cost=0.0..1.0 rows=5 width=4)\n  ->  Streaming(type: GATHER dop: 1/4)  (cost=0.0..1.0 rows=5 width=4)",
    "pretty": "--?  1 --Seq Scan on public.t1  (cost=.* rows=5 width=4)\n--?   Filter: (((x)::text = '5'))",
    "cast": "Seq Scan on t  (cost=0.0..1.0 rows=5 width=4) (actual rows=5 loops=1)\n  Filter: (grade = '17')\n  Rows Removed by Filter: 900",
    "symmetric": "Seq Scan on t  (cost=0.0..1.0 rows=5 width=4) (actual rows=5 loops=1)\n  Filter: ((grade)::text = '17'::text)\n  Rows Removed by Filter: 400",
    "nothing": "no plan at all",
    "empty": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    return parser.parse(spark.createDataFrame(list(PLANS.items()), "plan_id string, explain_text string")).cache()


def of(frame, plan, *columns):
    return [tuple(r) for r in frame.where(F.col("plan_id") == plan).orderBy("ord").select(*columns).collect()]


def test_nodes(parsed):
    n = parser.nodes(parsed)
    assert of(n, "large_loop", "node_type", "relation", "parent", "depth") == [("NestedLoop", None, None, 1), ("SeqScan", "big", 0, 2), ("IndexScan", "small", 0, 2)]
    assert of(n, "left_join", "node_type", "join_type", "streaming") == [("Hash", "Left", None), ("VectorStreaming", None, "LocalGather"), ("Streaming", None, "GATHER DOP: 1/4")]
    assert of(n, "never", "run.rows", "run.loops", "run.executed")[1] == (0.0, 1.0, False)
    assert of(n, "spill", "hash_batches", "peak_kb")[2] == (6, 3072.0)
    assert of(n, "pretty", "node_type", "relation", "filter") == [("SeqScan", "public.t1", "(((x)::text = '5'))")]
    assert not n.where("plan_id in ('nothing', 'empty')").head(1)


def test_summary_lines(parsed):
    assert [tuple(r) for r in parsed.where("plan_id = 'spill'").select("peak_memory", "total_runtime").collect()] == [(430000.0, 12.5)]


def test_findings(parsed):
    found = {}
    for r in rules.ordered(rules.findings(parsed)).orderBy("plan_id", "place").collect():
        found.setdefault(r["plan_id"], []).append((r["rule_id"], r["ord"]))
    assert found["external_sort"] == [("MEM-001", 0)]
    assert found["large_loop"] == [("JOIN-001", 0), ("SCAN-001", 1), ("SCAN-005", 2)]
    assert found["spill"] == [("JOIN-002", 2), ("MEM-004", None)]
    assert found["cast"] == [("TYPE-001", 0), ("SCAN-004", 0)]
    assert "symmetric" not in found and "never" not in found


def test_config(parsed):
    high = rules.findings(parsed, rules.Config(nested_loop_inner_rows=1e9, disabled=("MEM-001",)))
    assert not high.where("rule_id in ('JOIN-001', 'MEM-001')").head(1)


def test_ancestors_of_random_plans(spark):
    rng, plans, expected = random.Random(3), [], {}
    for k in range(60):
        indents = [0] + [2 * rng.randint(0, 6) for _ in range(rng.randint(0, 12))]
        plans.append((k, "\n".join(" " * i + "->  Seq Scan on t  (cost=0.0..1.0 rows=1 width=1)" for i in indents)))
        stack: list[int] = []
        for i, indent in enumerate(indents):
            while len(stack) > 1 and indents[stack[-1]] >= indent:
                stack.pop()
            expected[k, i] = list(reversed(stack))
            stack.append(i)
    n = parser.parse(spark.createDataFrame(plans, "plan_id int, explain_text string")).select("plan_id", F.inline("ns"))
    assert {(r["plan_id"], r["ord"]): r["ancestors"] for r in n.collect()} == expected


def test_heatmap_nested_mean(spark):
    text = "A  (cost=0.0..1.0 rows=10 width=1) (actual rows=40 loops=1)\n  ->  B  (cost=0.0..1.0 rows=10 width=1) (actual rows=90 loops=1)\n  ->  C  (cost=0.0..1.0 rows=10 width=1) (actual rows=10 loops=1)\n        ->  D  (cost=0.0..1.0 rows=10 width=1) (actual rows=160 loops=1)"
    h = analytics.heatmap(parser.parse(spark.createDataFrame([(1, text)], "plan_id int, explain_text string"))).orderBy("ord").collect()
    c = (1 * 16.0) ** 0.5
    assert [round(r["subtree_geo"], 9) for r in h] == [round(x, 9) for x in ((4 * 9 * c) ** (1 / 3), 9.0, c, 16.0)]
    assert [round(r["path"], 9) for r in h] == [4.0, 36.0, 4.0, 64.0]
    assert [r["critical_path"] for r in h] == [True, True, False, False]


def test_stream_of_plans(spark, tmp_path):
    from plansmith.streaming import plan_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(PLANS["external_sort"])
    seen = []
    q = plan_stream.stream_findings(plan_stream.plan_stream(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r["rule_id"] for r in df.collect()), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == ["MEM-001"]


def test_csv_batch(spark, tmp_path):
    from plansmith.sources import plan_files

    (tmp_path / "b.csv").write_text('id,EXPLAIN,Sql\n1,"Seq Scan on t  (cost=0.0..1.0 rows=5 width=4)\n  Filter: (a > 1)",select 1\n2,,select 2\n3,hello,select 3\n')
    got = {r["sql_text"]: r["parse_status"] for r in plan_files.read_csv(spark, str(tmp_path / "b.csv")).collect()}
    assert got == {"select 1": "ok", "select 2": "error: empty explain text", "select 3": "error: no plan nodes"}


def test_loop_stops():
    from plansmith.plans.optimizer import optimize

    costs = {"a": (100.0, 1), "b": (50.0, 0)}
    steps = optimize("a", costs.__getitem__, {"a": "b"}.get)
    assert [(s.sql, s.decision) for s in steps] == [("a", "Continue"), ("b", "Success")]
    assert optimize("a", costs.__getitem__, {"a": "b"}.get, lambda a, b: False)[-1].decision == "NotEquivalent"
