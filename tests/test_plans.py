"""Plan shapes that matter once the data no longer fits one machine."""

import re

import pytest
from pyspark.sql import functions as F

from cohorta.operators import features as P
from cohorta.operators import hierarchy as H
from cohorta.operators.ranking import add_ranks
from cohorta.operators.scoring import score_with_model_table


def test_ranking_moves_the_rows_once(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("g"), (F.col("id") * 7 % 101).alias("s"))
    ranked = add_ranks(df, "s", "id", ["g"], ("average", "first", "min", "max"))
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert "SinglePartition" not in plan
    physical = ranked._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", physical)
    # The rows by cell; the cells once to be counted, once by group to be summed up.
    assert len([e for e in exchanges if "__slice" in e and "__piece" in e]) <= 3
    assert not [e for e in exchanges if e.startswith("__by0") and "__slice" not in e and "id#" in e]


SHUFFLE_ONLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
}


@pytest.fixture()
def hot(spark, tmp_path):
    """Rows of which a third share one key, in a session that treats 200 kB as large."""
    path = str(tmp_path / "t")
    spark.range(200_000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(1.0).alias("v"),
        F.xxhash64("id").cast("string").alias("pad"),
    ).repartition(8).write.parquet(path)
    before = {k: spark.conf.get(k, None) for k in SHUFFLE_ONLY}
    for key, value in SHUFFLE_ONLY.items():
        spark.conf.set(key, value)
    yield spark.read.parquet(path)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_split_when_its_mean_is_joined(hot):
    out = P.target_mean(hot, ["k"], "v", "m")
    assert "skew=true" in final_plan(out)
    assert out.where("m = 1.0").count() == 200_000


def test_hot_key_is_split_when_models_are_joined(hot):
    models = hot.select(
        "k", F.lit("v").alias("feature"), F.lit(2.0).alias("coef"), F.lit(0.0).alias("mean"),
        F.lit(1.0).alias("scale"), F.lit(1.0).alias("intercept"),
    ).distinct()
    out = score_with_model_table(hot, models, ["v"], ["k"], max_broadcast_bytes=0)
    assert "skew=true" in final_plan(out)
    assert out.where("Score_Predit = 3.0").count() == 200_000


def test_hot_parent_is_split_when_children_are_listed(spark, hot):
    parents = hot.select(F.col("k").alias("id")).distinct()
    children = hot.select("id", F.col("pad").alias("name"), F.col("k").alias("parent"))
    out = H.children_of_parents(parents, parents, children, "parent")
    assert "skew=true" in final_plan(out)
    assert out.count() == 200_000


def test_hot_name_is_split_when_a_batch_is_appended(hot):
    existing = hot.limit(0).select("id", F.col("pad").alias("name"))
    incoming = hot.select(F.col("id").alias("seq"), F.concat(F.lit("n"), F.col("k")).alias("name"))
    accepted, rejected = H.append_entries(existing, incoming)
    assert "skew=true" in final_plan(rejected)
    assert accepted.count() + rejected.count() == 200_000
