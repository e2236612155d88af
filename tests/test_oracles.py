"""Every registered query with SQL gives what the SQL gives."""

import os

import pytest

import __spark_entry__ as contract
import oracle
from cohorta.workload.registry import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


# No pairing of everything with everything, and no rows through Python.
SLOW_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    df = contract.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The optional text queries choose their own style; their results are held to the same rule.
    assert name not in ORACLES or not [node for node in SLOW_NODES if node in plan]
    assert oracle.difference(df, connection, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns[:3] == ["row_id", "status", "score"]


def test_fitted_scores_cover_every_applicant(spark):
    df = contract.queries()["fit_and_score"](spark, SF_DIR)
    rows = df.collect()
    allowed = {"NON ADMIS", "DEUXIÈME SESSION", "PASSABLE", "MENTION SUPÉRIEURE"}
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    assert {r["Prediction_Status"] for r in rows} <= allowed
    assert all(r["Score_Predit"] is not None for r in rows)
