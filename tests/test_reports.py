"""Messages of findings, several plans in a text, scores, sessions, batch columns, stored tables, streams."""

import json

import pytest
from oracle import DATA
from pyspark.sql import functions as F
from test_plans import PLANS

from plansmith.functions import procedures, scores, sql_text
from plansmith.operators import stored
from plansmith.plans import analytics, optimizer, parser, reports, rules

NODE = "{}  (cost=0.0..9.0 rows={} width=8) (actual time=0.1..9.0 rows={} loops={})"
MORE = {
    "broadcast": NODE.format("Streaming(type: BROADCAST)", 77000, 77000, 1) + "\n  ->  " + NODE.format("Seq Scan on dim", 9, 9, 1),
    "layers": NODE.format("Streaming(type: REDISTRIBUTE)", 10, 10, 1) + "\n  ->  " + NODE.format("Streaming(type: BROADCAST)", 10, 10, 1) + "\n        ->  " + NODE.format("Seq Scan on f", 10, 10, 1) + "\n              Filter: (ts > now())",
    "estimate": NODE.format("Seq Scan on e", 40, 81000, 1) + "\n  Filter: (a > 1)",
    "like": NODE.format("Seq Scan on names", 5, 5, 1) + "\n  Filter: (n ~~ '%important%'::text)",
    "adapters": NODE.format("Row Adapter", 5, 5, 1) + "\n  ->  " + NODE.format("Vector Adapter", 5, 5, 1) + "\n        ->  " + NODE.format("CStore Scan on c", 5, 5, 1),
    "sorts": NODE.format("Sort", 5, 5, 1) + "\n  Sort Key: k\n  ->  " + NODE.format("Sort", 5, 5, 1) + "\n        Sort Key: k",
    "update": "Update on target  (cost=0.0..9.0 rows=9 width=8)\n  ->  Seq Scan on target  (cost=0.0..9.0 rows=9 width=8)\n        Filter: (SubPlan 1)\n        ->  Seq Scan on target  (cost=0.0..9.0 rows=9 width=8)",
    "list": NODE.format("Seq Scan on l", 5, 5, 1) + "\n  Filter: (id IN (" + ", ".join(str(i) for i in range(14)) + "))",
}


@pytest.fixture(scope="module")
def found(spark):
    plans = spark.createDataFrame([*PLANS.items(), *MORE.items()], "plan_id string, explain_text string")
    return rules.findings(parser.parse(plans)).cache()


@pytest.mark.parametrize(
    "plan, rule, words, table, columns",
    [
        ("large_loop", "SCAN-001", ["big", "40000"], "big", []),
        ("large_loop", "JOIN-001", ["40000", "loops"], "big", []),
        ("cast", "SCAN-004", ["Filter", "900"], "t", ["grade"]),
        ("cast", "TYPE-001", ["grade = '17'", "implicit type cast"], "t", ["grade"]),
        ("spill", "JOIN-002", ["6 batches"], "b", []),
        ("spill", "MEM-004", ["430000"], None, []),
        ("external_sort", "MEM-001", ["external", "by k"], "ev", []),
        ("broadcast", "NET-001", ["77000", "Broadcast"], "dim", []),
        ("layers", "PUSH-001", ["Streaming", "pushed down"], "f", []),
        ("layers", "PUSH-002", ["2 layers", "Redistribute > Broadcast"], "f", []),
        ("estimate", "EST-001", ["81000", "40"], "e", []),
        ("like", "TYPE-004", ["LIKE", "important"], "names", ["n"]),
        ("adapters", "VEC-001", ["2 Adapter", "RowAdapter"], None, []),
        ("sorts", "SORT-003", ["Sort", "duplicate"], None, []),
        ("update", "SUBQ-006", ["target", "SubPlan"], "target", []),
        ("list", "REW-001", ["14 values"], "l", ["id"]),
    ],
)
def test_messages(found, plan, rule, words, table, columns):
    r = found.where(F.col("plan_id") == plan).where(F.col("rule_id") == rule).head()
    assert all(w in r["detail"] for w in words), r["detail"]
    assert r["table"] == table and r["columns"] == columns and r["detail_zh"] and r["detail_zh"] != r["detail"]


def test_hints_and_evidence(found):
    h = rules.hints(found.where("plan_id = 'cast' and rule_id = 'TYPE-001'")).head()
    assert (h["table"], h["columns"], h["severity"]) == ("t", ["grade"], "critical")
    (e,) = found.where("plan_id = 'estimate' and rule_id = 'EST-001'").head()["evidence"]
    assert (e["line"], e["node_type"], e["rows"], e["estimated"], e["confidence"]) == (1, "SeqScan", 81000.0, 40.0, 1.0)
    assert len(found.where("rule_id = 'VEC-001'").head()["evidence"]) == 2


def test_all_sentences_are_written(found):
    from plansmith.plans import messages

    assert set(messages.SENTENCES) | set(messages.OF_PLANS) == {r.id for r in rules.ALL}
    assert found.where("detail is null or detail_zh is null").count() == 0


def test_several_plans_in_a_text(spark):
    text = "SELECT 1;\n" + MORE["sorts"] + "\nTotal runtime: 3.5 ms\n(4 rows)\n\n" + MORE["broadcast"] + "\nTotal runtime: 9.5 ms"
    d = spark.createDataFrame([("x", text), ("y", "no plan"), ("z", "  ")], "plan_id string, explain_text string")
    (one,) = parser.parse(d).collect()
    assert [n["node_type"] for n in one["ns"]] == ["Sort", "Sort"] and one["total_runtime"] == 3.5
    each = {r["plan_id"]["number"]: ([n["node_type"] for n in r["ns"]], r["total_runtime"]) for r in parser.parse_each(d).collect()}
    assert each == {1: (["Sort", "Sort"], 3.5), 2: (["Streaming", "SeqScan"], 9.5)}
    assert {r["plan_id"]: r["status"] for r in parser.parse_status(d).collect()} == {"x": "ok", "y": "no plan", "z": "empty"}


def test_actions_of_all_rules(spark):
    d = spark.createDataFrame([(r.id,) for r in rules.ALL], "rule_id string")
    got = {r["rule_id"]: r["action"] for r in optimizer.map_diagnostic(d).collect()}
    assert (got["REW-001"], got["SUBQ-006"], got["MEM-004"], got["AGG-002"], got["EST-004"], got["GEN-001"]) == ("Rewrite", "Rewrite", "ConfigAdvice", "ConfigAdvice", "RunAnalyze", "Log")


def test_fingerprints_look_at_merge_keys(spark):
    plan = NODE.format("Merge Append", 5, 5, 1) + "\n  {}: {}"
    d = spark.createDataFrame([(i, plan.format(*x)) for i, x in enumerate([("Merge Sort Key", "a"), ("Merge Sort Key", "b"), ("Recheck Cond", "a"), ("Recheck Cond", "b")])], "plan_id int, explain_text string")
    f = {r["plan_id"]: r["fingerprint"] for r in analytics.fingerprints(parser.parse(d)).collect()}
    assert f[0] != f[1] and f[2] == f[3]


def test_column_of_a_filter(spark):
    cases = {"(grade = '17')": "grade", "((code)::text = '1'::text)": "code", "((a >= 5) AND (b = 'x'))": "b", "(a = b)": None, "((a = b) AND (c = 7))": "c", "((p)::numeric = '3')": "p", "(f(x) = 3)": "x", "plain": None}
    d = spark.createDataFrame(list(cases.items()), "filter string, want string")
    assert d.withColumn("got", F.expr(rules.COLUMN)).where("not (got <=> want)").collect() == []


@pytest.mark.parametrize(
    "sql, kind, sub",
    [
        ("select 1", "Query", "SELECT"), ("WITH a AS (SELECT 1) SELECT 2", "Query", "SELECT"), ("explain analyze delete from t", "DML", "DELETE"), ("CREATE OR REPLACE PACKAGE BODY p AS", "Package", "CREATE PACKAGE BODY"),
        ("create unique index i on t(a)", "DDL", "CREATE INDEX"), ("DO $$ begin end $$", "PLBlock", "DO"), ("declare x int; begin end", "PLBlock", "ANONYMOUS BLOCK"), ("VACUUM", "Query", "OTHER"), ("merge into t", "DML", "MERGE"),
    ],
)
def test_kinds_of_statements(spark, sql, kind, sub):
    r = spark.createDataFrame([(sql,)], "sql string").select(scores.classify(F.col("sql")).alias("k")).head()["k"]
    assert (r["category"], r["sub_type"]) == (kind, sub)


def test_create_table_score(spark):
    d = sql_text.counters(spark.createDataFrame([("CREATE TABLE t (a int, b varchar(10), c int GENERATED ALWAYS AS (a + 1) STORED, CHECK (a > 0))",)], "sql string"), "sql")
    assert d.select(scores.statement_score().alias("s")).head()["s"] == 10 + 2 * 4 + 15 + 10


def test_procedures_and_packages(spark):
    rows = [(1, 6, 4, 1, 2, 1, 1, 3, 4, 2, 1, 0), (1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1)]
    names = "package tables joins subqueries loops loop_depth cursors cursor_ops cursor_depth dynamic autonomous java_procedures".split()
    d = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    a, b = scores.procedure_score(d).collect()
    assert a["overall"] == 60 + 60 + 20 + 30 + 30 + 15 and a["breakdown"]["cursor"] == (10 + 15) * (1 + 3 * 15) and a["tags"] == ["HighTableCount", "DynamicSql", "TransactionComplex", "LargeJoin"]
    assert b["overall"] == 50 and b["tags"] == ["JavaProcedure"]
    (p,) = scores.package_score(d.withColumn("is_variable", F.lit(False)).unionByName(d.limit(1).select(*[F.lit(0).alias(n) if n != "package" else F.col(n) for n in names]).withColumn("is_variable", F.lit(True))), "package").collect()
    assert (p["package_procedures"], p["package_variables"]) == (2, 1) and p["breakdown"]["package"] == 12
    assert procedures.counters(spark.createDataFrame([(None,), ("",)], "b string"), "b").where("loops = 0").count() == 2


def test_sessions(spark):
    def plan(ms, table="t"):
        return NODE.format(f"Seq Scan on {table}", 5, 5, 1) + f"\nTotal runtime: {ms} ms"

    rows = [("a", "s", 1, plan(10)), ("b", "s", 2, plan(30)), ("c", "s", 3, plan(160, "u")), ("d", "alone", 1, plan(5)), ("e", "alone", 2, "nothing")]
    steps = reports.session_steps(spark.createDataFrame(rows, "plan_id string, session_id string, seq int, explain_text string"))
    got = {r["plan_id"]: (r["contribution"], r["bottleneck"]) for r in reports.session_bottlenecks(steps).collect()}
    assert got == {"a": (5.0, "None"), "b": (15.0, "None"), "c": (80.0, "Primary"), "d": (100.0, "Primary")}
    (g,) = reports.session_groups(steps).collect()
    assert (g["session_id"], g["runs"], g["total"], g["degradation"], g["place"]) == ("s", 2, 40.0, 1.5, 1)


def test_batch_columns(spark, tmp_path):
    rows = [("1", "SELECT a FROM t WHERE a = 1", PLANS["cast"]), ("2", "SELECT 2", "no plan")]
    d = spark.createDataFrame(rows, "plan_id string, sql string, explain_text string")
    for columns, n in (("minimal", 9), ("focused", 20), ("full", 53)):
        assert len(reports.batch(d, columns).columns) == n + 1
    one, two = reports.batch(d).orderBy("plan_id").collect()
    assert (one["parse_status"], one["findings_total"], one["critical_count"], one["complexity_score"], one["sql_category"], one["has_group_by"]) == ("ok", 2, 1, 2.0, "Query", "N")
    assert one["findings"].startswith("TYPE-001: ") and (two["parse_status"], two["findings_total"], two["findings"]) == ("error: no plan", 0, "")
    assert len(reports.SUMMARY) == 48 and reports.summary(d).columns == ["plan_id", *reports.SUMMARY]
    reports.write_batch(d, str(tmp_path / "out"), "focused")
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out")).count() == 2
    told = {r["plan_id"]: json.loads(r["report"]) for r in reports.report_json(d).collect()}
    assert set(told) == {"1"} and {"stats", "nodes", "findings"} <= set(told["1"]) and len(told["1"]["findings"]) == 2


def test_tools(spark):
    assert len(reports.list_rules()) == 35 and reports.config_of("[rules]\nmax_plan_depth = 3\ndisabled = ['EST-001']") == rules.Config(max_plan_depth=3, disabled=("EST-001",))
    with pytest.raises(TypeError):
        reports.config_of("unknown = 1")
    s = reports.schemas(spark)
    assert {f["name"] for f in s["findings"]["fields"]} >= {"rule_id", "detail", "evidence", "columns"} and len(s["summary"]["fields"]) == 49


def test_partitioned_scans_are_pruned(spark):
    days = stored._days(spark, DATA).where("day = date'2024-01-07' and event_id > 100").select("event_id")
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThan(event_id,100)" in plan and "ReadSchema: struct<event_id:bigint>" in plan


def test_event_streams(spark, tmp_path):
    from plansmith.streaming import plan_stream

    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    for k, f in enumerate((plan_stream.windowed_runtime, plan_stream.user_sessions)):
        s = f(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
        q = s.writeStream.format("memory").queryName(f"out{k}").outputMode("append" if k else "update").option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(f"out{k}")
        if not k:
            assert got.agg(F.sum("n")).head()[0] == e.count()
        else:  # sessions come out once the watermark has passed them
            assert 0 < got.agg(F.sum("n")).head()[0] <= e.count()
