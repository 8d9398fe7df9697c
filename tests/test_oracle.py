"""A sample of registered queries against their SQL at the smallest scale, and plan checks."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["fact_financial_terms", "label_questions", "stat_entropy_weights", "stat_group_percentiles", "cut_page_sections",
          "conflict_components", "trust_index", "graph_ego", "report_level_percentages", "compare_numbered", "risk_levels_as_of",
          "audit_positions", "files_pages", "cut_near_copies"]


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    rel = connect(SF).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rel.fetchall())


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["fact_mentions", "risk_roll_up", "stat_gini", "conflict_numeric"])
def test_plans_have_no_cartesian_products(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
