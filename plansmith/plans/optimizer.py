"""The tuning loop: what a finding calls for, when to stop, whether a rewrite kept the result, and how good the findings are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansmith.plans.rules import ALL
from plansmith.registry import query, table

#: What each rule calls for: kind and name of the action (fixed values); other rules are logged.
ACTIONS = {
    "SUBQ-001": ("Rewrite", "subquery-to-join"), "REW-001": ("Rewrite", "subquery-to-join"), "SUBQ-006": ("Rewrite", "subquery-to-join"), "TYPE-001": ("Rewrite", "add-explicit-cast"),
    "TYPE-004": ("Rewrite", "suggest-trgm-index"), "AGG-001": ("Rewrite", "rewrite-group-agg"), "SCAN-001": ("DdlAdvice", "index"), "SCAN-004": ("DdlAdvice", "index"), "JOIN-001": ("DdlAdvice", "index"),
    "MEM-001": ("ConfigAdvice", "work_mem"), "MEM-004": ("ConfigAdvice", "work_mem"), "JOIN-002": ("ConfigAdvice", "work_mem"), "AGG-002": ("ConfigAdvice", "work_mem"),
    "STATS-001": ("RunAnalyze", "analyze"), "EST-001": ("RunAnalyze", "analyze"), "EST-004": ("RunAnalyze", "analyze"),
}


def map_diagnostic(found: DataFrame) -> DataFrame:
    """Adds action and target to findings."""
    lookup = F.create_map(*[x for k, (a, b) in ACTIONS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("action"), F.lit(b).alias("target")))])
    hit = lookup[F.col("rule_id")]
    return found.withColumns({"action": F.coalesce(hit["action"], F.lit("Log")), "target": hit["target"]})


def rewritable(mapped: DataFrame) -> DataFrame:
    """Findings with a rewrite; a subquery's needs a table."""
    return mapped.where("action = 'Rewrite' AND (rule_id <> 'SUBQ-001' OR table IS NOT NULL)")


def decisions(snapshots: DataFrame, run: str, max_iterations: int = 10) -> DataFrame:
    """Adds decision to a run's snapshots (iteration, cost, critical, seen, rewritable): the first reason that holds, in this order.

    FixedPoint (the text was seen), Success (no critical finding), Regression (cost over 1.1 of the last), MaxIterations, Plateau (three gains
    under 5 % in a row), NoRewritable, Continue.
    """
    w = Window.partitionBy(run).orderBy("iteration")
    before = F.lag("cost").over(w)
    flat = F.when(before.isNotNull() & (before > 0) & ((before - F.col("cost")) / before < 0.05), 1).otherwise(0)
    s = snapshots.withColumn("__before", before).withColumn("__flat", flat)
    s = s.withColumn("__plateau", (F.sum("__flat").over(w.rowsBetween(-2, 0)) == 3))
    reason = (
        F.when(F.col("seen"), "FixedPoint")
        .when(F.col("critical") == 0, "Success")
        .when(F.col("cost") > F.col("__before") * 1.10, "Regression")
        .when(F.col("iteration") >= max_iterations, "MaxIterations")
        .when(F.col("__plateau"), "Plateau")
        .when(~F.col("rewritable"), "NoRewritable")
        .otherwise("Continue")
    )
    return s.withColumn("decision", reason).drop("__before", "__flat", "__plateau")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often than the other: empty means no difference on these data, which refutes but never proves."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


@dataclass
class Step:
    iteration: int
    sql: str
    cost: float
    critical: int
    decision: str


def optimize(sql: str, explain: Callable[[str], tuple[float, int]], rewrite: Callable[[str], str | None], same: Callable[[str, str], bool] = lambda a, b: True, most: int = 10) -> list[Step]:
    """Rewrites until a reason to stop: explain gives (cost, critical findings), rewrite a new text or None, same whether results agree."""
    seen: set[str] = set()
    steps: list[Step] = []
    flat = 0
    for i in range(1, most + 1):
        cost, critical = explain(sql)
        before = steps[-1].cost if steps else None
        flat = flat + 1 if before and (before - cost) / before < 0.05 else 0
        new = rewrite(sql)
        reason = (
            "FixedPoint" if sql in seen else "Success" if critical == 0 else "Regression" if before and cost > before * 1.1 else "MaxIterations" if i == most else "Plateau" if flat >= 3 else "NoRewritable" if new is None or new == sql else "Continue"
        )
        if reason == "Continue" and not same(sql, new):
            reason = "NotEquivalent"
        steps.append(Step(i, sql, cost, critical, reason))
        if reason != "Continue":
            break
        seen.add(sql)
        sql = new
    return steps


def confusion(expected: DataFrame, reported: DataFrame, by: list[str], unreachable: list[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 (percent) of rules reported for cases; rules that can't be reached here don't count as missed."""
    e = expected.select("case_id", "rule_id").distinct().withColumn("e", F.lit(True))
    r = reported.select("case_id", "rule_id").distinct().withColumn("r", F.lit(True))
    both = e.join(r, ["case_id", "rule_id"], "full").where(F.col("r").isNotNull() | ~F.col("rule_id").isin(list(unreachable)))
    hit = F.col("e").isNotNull() & F.col("r").isNotNull()
    g = both.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("r").isNull()).alias("fn"))
    return g.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    p, r = F.when(tp + fp > 0, tp * 100 / (tp + fp)).otherwise(zero), F.when(tp + fn > 0, tp * 100 / (tp + fn)).otherwise(zero)
    return {"precision": F.round(p, 1), "recall": F.round(r, 1), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(zero), 1)}


_SNAPS = [(1, 1, 100.0, 2, False, True), (1, 2, 98.0, 2, False, True), (1, 3, 97.0, 2, False, True), (1, 4, 96.5, 2, False, True), (2, 1, 50.0, 1, False, True), (2, 2, 60.0, 1, False, True), (3, 1, 50.0, 1, False, True), (3, 2, 20.0, 0, False, True), (4, 1, 9.0, 1, False, False), (5, 1, 9.0, 1, False, True), (5, 2, 5.0, 1, True, True)]
_SAID = ["Continue", "Continue", "Continue", "Plateau", "Continue", "Regression", "Continue", "Success", "NoRewritable", "Continue", "FixedPoint"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({r}, {i}, '{d}')" for (r, i, *_), d in zip(_SNAPS, _SAID, strict=True)) + ") AS t(run, iteration, decision)")
def converge_decision(spark, sf_dir):
    s = spark.createDataFrame(_SNAPS, "run int, iteration int, cost double, critical int, seen boolean, rewritable boolean")
    return decisions(s, "run").select("run", "iteration", "decision")


@query(
    """SELECT rule_id, CASE WHEN rule_id IN ('SUBQ-001', 'REW-001', 'SUBQ-006', 'TYPE-001', 'TYPE-004', 'AGG-001') THEN 'Rewrite' WHEN rule_id IN ('SCAN-001', 'SCAN-004', 'JOIN-001') THEN 'DdlAdvice'
        WHEN rule_id IN ('MEM-001', 'MEM-004', 'JOIN-002', 'AGG-002') THEN 'ConfigAdvice' WHEN rule_id IN ('STATS-001', 'EST-001', 'EST-004') THEN 'RunAnalyze' ELSE 'Log' END AS action,
    CASE WHEN rule_id IN ('SUBQ-001', 'REW-001', 'SUBQ-006') THEN 'subquery-to-join' WHEN rule_id = 'TYPE-001' THEN 'add-explicit-cast' WHEN rule_id = 'TYPE-004' THEN 'suggest-trgm-index'
        WHEN rule_id = 'AGG-001' THEN 'rewrite-group-agg' WHEN rule_id IN ('SCAN-001', 'SCAN-004', 'JOIN-001') THEN 'index' WHEN rule_id IN ('MEM-001', 'MEM-004', 'JOIN-002', 'AGG-002') THEN 'work_mem'
        WHEN rule_id IN ('STATS-001', 'EST-001', 'EST-004') THEN 'analyze' END AS target FROM (SELECT unnest(["""
    + ", ".join(f"'{r.id}'" for r in ALL)
    + "]) AS rule_id)"
)
def map_diagnostics(spark, sf_dir):
    """What each of all rules calls for."""
    return map_diagnostic(spark.createDataFrame([(r.id,) for r in ALL], "rule_id string"))


@query("(SELECT o_custkey, 'left' AS side FROM orders WHERE o_totalprice > 300000 EXCEPT ALL SELECT DISTINCT o_custkey, 'left' FROM orders WHERE o_totalprice > 300000)")
def differential_verify(spark, sf_dir):
    """A join without DISTINCT against the EXISTS that it should equal: copies show up."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey")
    return differences(o, o.distinct())


_EXPECTED = [("c1", "SCAN-001"), ("c1", "JOIN-001"), ("c2", "SCAN-001"), ("c3", "TYPE-001")]
_REPORTED = [("c1", "SCAN-001"), ("c2", "SCAN-001"), ("c2", "EST-001"), ("c3", "SCAN-001")]


def _cases(spark, rows):
    return spark.createDataFrame(rows, "case_id string, rule_id string")


@query("SELECT * FROM (VALUES ('SCAN-001', CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), 66.7, 100.0, 80.0), ('JOIN-001', 0, 0, 1, 0.0, 0.0, 0.0), ('TYPE-001', 0, 0, 1, 0.0, 0.0, 0.0), ('EST-001', 0, 1, 0, 0.0, 0.0, 0.0)) AS t(rule_id, tp, fp, fn, precision, recall, f1)")
def eval_by_rule(spark, sf_dir):
    return confusion(_cases(spark, _EXPECTED), _cases(spark, _REPORTED), ["rule_id"])


@query("SELECT CAST(2 AS BIGINT) AS tp, CAST(2 AS BIGINT) AS fp, CAST(1 AS BIGINT) AS fn, 50.0 AS precision, 66.7 AS recall, 57.1 AS f1")
def eval_overall(spark, sf_dir):
    """TYPE-001 can't be reached."""
    return confusion(_cases(spark, _EXPECTED), _cases(spark, _REPORTED), [], ["TYPE-001"])
