import pytest
from pyspark.sql import functions as F

from cohorta.operators.scoring import Split, score_batch
from cohorta.plans import fit


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(600).select(
        F.col("id").alias("row_id"), (F.col("id") % 30).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"),
        F.lit(1.0).alias("constant"),
    )
    return df.withColumn("target", 3 * F.col("x") - 2 * F.col("y") + 5)


def test_tree_finds_the_threshold(data):
    tree = fit.fit_tree(data, ["x", "y"], (F.col("x") > 14).cast("int"), max_depth=2)
    assert isinstance(tree, Split)
    assert tree.feature == "x" and 14 <= tree.threshold < 15
    assert (tree.left, tree.right) == (0, 1)


def test_linear_model_recovers_the_line(data):
    model = fit.fit_linear(data, ["x", "y", "constant"], "target", penalty=1e-6)
    raw = {t.feature: t.coef / t.scale for t in model.terms}
    assert raw["x"] == pytest.approx(3, abs=1e-3)
    assert raw["y"] == pytest.approx(-2, abs=1e-3)
    assert raw["constant"] == pytest.approx(0, abs=1e-9)
    means = {t.feature: (t.mean, t.scale) for t in model.terms}
    # Population deviation of 0..29.
    assert means["x"] == (pytest.approx(14.5), pytest.approx((899 / 12) ** 0.5))


def test_cascade_scores_its_own_training_rows(data):
    labels = {
        "admission": (F.col("x") > 5).cast("int"),
        "session": (F.col("y") > 2).cast("int"),
        "mention": (F.col("x") > 20).cast("int"),
    }
    cascade = fit.fit_cascade(data, ["x", "y"], ["x", "y"], labels, "target")
    rows = score_batch(data, cascade).collect()
    want = {
        r["row_id"]: "non_admi" if r["x"] <= 5 else "deuxieme_session" if r["y"] <= 2 else "passable" if r["x"] <= 20 else "mention"
        for r in rows
    }
    assert all(r["Model_Utilise"] == want[r["row_id"]] for r in rows)
    assert all(abs(r["Score_Predit"] - r["target"]) < 0.5 for r in rows)
