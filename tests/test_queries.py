"""Every registered query against its SQL; those without SQL must run."""

import pytest
from oracle import DATA, duck, rows_of

import plansmith.functions.procedures
import plansmith.functions.scores
import plansmith.functions.sql_text
import plansmith.operators
import plansmith.plans.optimizer
import plansmith.plans.queries
import plansmith.plans.reports
import plansmith.plans.rewrite
import plansmith.sources.plan_files  # noqa: F401
from plansmith.registry import ORACLE, QUERIES

#: Rules are compared together by the findings_* queries; a few alone are enough here.
ALONE = ["rule_scan_001", "rule_subq_006", "rule_type_001", "rule_vec_001", "rule_anti_009"]
NAMES = [n for n in QUERIES if not n.startswith("rule_") or n in ALONE]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    frame = QUERIES[name](spark, DATA).toPandas()
    assert name not in ORACLE or rows_of(frame) == rows_of(duck(ORACLE[name]))
