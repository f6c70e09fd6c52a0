"""Sessions: steps are what parsed plans tell, and lines are told apart once."""

from oracle import DATA
from pyspark.sql import functions as F

import plansmith.plans.reports  # noqa: F401
from plansmith.plans import analytics, parser, reports
from plansmith.registry import QUERIES

NODE = "Sort  (cost=0.00..1.25 rows=1 width=8) (actual time=0.010..7.500 rows=1 loops=1)"
CHILD = "  ->  Hash Join  (cost=0.00..1.25 rows=1 width=8)"
TEXTS = [
    f"QUERY PLAN\n-----\n{NODE}\n  Sort Key: a\n  Sort Method: external merge  Disk: 30kB\n  Sort Method: external merge  Disk: 8kB\n{CHILD}\n    Hash Cond: (a = b)\n    Join Filter: (a > b)\nTotal runtime: 5.5 ms",
    f"QUERY PLAN\n{NODE}\n  Sort Method: external merge  Disk: 30kB\n  Sort Method: quicksort  Memory: 8kB\nTotal runtime: 1.0 ms\nTotal runtime: 2.0 ms\nQUERY PLAN\n{NODE}\n  Sort Key: later\n  Sort Method: external merge  Disk: 99kB\nTotal runtime: 9.0 ms",
    f"Filter: (before)\nSort Method: external merge  Disk: 5kB\n{NODE}\n  Filter: (a)\n  Sort Key: b\n{NODE}\n  Filter: (second)",
    f"Total runtime: none\n{NODE}\n",
    f"{CHILD}\n{CHILD}\n{NODE}\nTotal runtime: 3 ms",
    "no plan", "", None,
    "Seq Scan on t1  (cost=0.00..1.25 rows=1 width=8)\r\n  Filter: (a)\r\n  Filter: (b)\r\nVector Streaming(type: GATHER)  (cost=0.00..1.25 rows=1 width=8)",
]


def test_steps_are_what_parsed_plans_tell(spark):
    plans = spark.createDataFrame([(i, i % 2, i, t) for i, t in enumerate(TEXTS)], "plan_id long, session_id long, seq long, explain_text string")
    disk = F.expr("aggregate(ns, 0D, (t, n) -> t + coalesce(try_cast(regexp_replace(n.sort_disk, 'kB$', '') AS double), 0D))")
    told = parser.parse(plans).select("plan_id", F.expr("coalesce(total_runtime, ns[0].run.time, 0D)").alias("runtime_ms"), disk.alias("spill_kb"), analytics.fingerprint().alias("fingerprint"))
    want = sorted(tuple(r) for r in told.collect())
    assert [r[:3] for r in want[:4]] == [(0, 5.5, 8.0), (1, 2.0, 0.0), (2, 7.5, 0.0), (3, 7.5, 0.0)] and len(want) == 6
    assert sorted(tuple(r) for r in reports.session_steps(plans).select("plan_id", "runtime_ms", "spill_kb", "fingerprint").collect()) == want


def test_sessions_tell_lines_apart_once(spark):
    for name in ("session_plan_groups", "session_plans"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode") == 1, name


def test_limit_of_generated_methods_is_set(spark):
    QUERIES["session_plan_groups"](spark, DATA)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
