"""Grouped fits against a plain coordinate descent, and their way into scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.operators.scoring import score_with_model_table
from cohorta.plans.fit import fit_linear
from cohorta.plans.fit_groups import fit_by_group, fit_cohort_models, group_moments


def plain_lasso(x, y, penalty):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1)
    z, t, coef = (x - mean) / scale, y - y.mean(), np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(coef)):
            own = z[:, j] @ z[:, j] / len(y)
            rest = z[:, j] @ (t - z @ coef) / len(y) + own * coef[j]
            coef[j] = np.sign(rest) * max(abs(rest) - penalty, 0) / own if own else 0.0
    return coef, mean, scale, y.mean()


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(4)
    made = {}
    for g, n in (("p", 60), ("q", 40), ("r", 3), (None, 25)):
        x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 0] + [0, 100, 1e6, 5]
        x[:, 1] += 8 * x[:, 0]
        made[g] = (x, x @ [2.0, -0.5, 3.0, 1.0] + rng.normal(size=n))
    return made


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(g, *map(float, a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)]
    return spark.createDataFrame([*rows, ("p", 1.0, 1.0, 1.0, 1.0, None)], "k string, a double, b double, c double, d double, y double")


@pytest.mark.parametrize("penalty", [0.05, 1.0, 1e9])
def test_lasso_of_each_group(groups, table, penalty):
    found = {}
    for r in fit_by_group(table, "abcd", "y", ["k"], penalty).collect():
        found.setdefault(r["k"], []).append(r)
    assert set(found) == set(groups)
    for g, (x, y) in groups.items():
        coef, mean, scale, intercept = plain_lasso(x, y, penalty)
        rows = sorted(found[g], key=lambda r: r["ord"])
        assert [r["feature"] for r in rows] == list("abcd")
        assert np.allclose([r["coef"] for r in rows], coef, atol=1e-7)
        assert np.allclose([r["mean"] for r in rows], mean) and np.allclose([r["scale"] for r in rows], scale)
        assert np.isclose(rows[0]["intercept"], intercept)


def test_one_group_like_the_single_fit(groups, table):
    single = fit_linear(table.where("k = 'p'"), "abcd", "y", penalty=0.2, max_iter=500)
    rows = sorted(fit_by_group(table, "abcd", "y", ["k"], 0.2).where("k = 'p'").collect(), key=lambda r: r["ord"])
    assert np.allclose([t.coef for t in single.terms], [r["coef"] for r in rows], atol=1e-3)


def test_moments_count_missing_values_as_zero(spark):
    df = spark.createDataFrame([("p", None, 2.0), ("p", float("nan"), 4.0), ("p", 3.0, None)], "k string, a double, y double")
    got = group_moments(df, ["a"], "y", ["k"]).first()
    assert (got["n"], got["target_mean"], got["means"], got["scales"]) == (2, 3.0, [0.0], [1.0])
    assert fit_by_group(df, ["a"], "y", ["k"]).first()["coef"] == 0.0
    assert fit_by_group(df.limit(0), ["a"], "y", ["k"]).count() == 0
    with pytest.raises(ValueError, match="feature"):
        fit_by_group(df, [], "y", ["k"])


def test_fitted_models_score_their_cohorts(spark, groups, table):
    named = table.where("k IS NOT NULL").withColumnRenamed("k", "cohort").withColumn("late", (F.col("a") > 0).cast("int"))
    labels = {"admission": F.lit(1), "session": F.col("late"), "mention": F.lit(0)}
    models = fit_cohort_models(named, "abcd", labels, "y", penalty=0.0)
    assert {r["model_key"] for r in models.select("model_key").distinct().collect()} == {"deuxieme_session", "passable"}
    keyed = named.withColumn("model_key", F.when(F.col("late") == 1, "passable").otherwise("deuxieme_session"))
    scored = score_with_model_table(keyed.where("y IS NOT NULL"), models, "abcd", ["cohort", "model_key"])
    got = scored.groupBy("cohort", "model_key").agg(F.avg(F.col("Score_Predit") - F.col("y")).alias("e")).collect()
    assert all(abs(r["e"]) < 1e-5 for r in got)
