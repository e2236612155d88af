"""Model scoring, probability, message and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions.scalar import (
    ADVICE_ORIENTATION,
    ADVICE_SUCCESS,
    ADVICE_V1,
    advice_v1,
    advice_v2,
    as_column,
    normalise_score,
    orientation_percentage,
)
from cohorta.operators import scoring as M
from cohorta.plans import fit, predict
from cohorta.plans.predict import score_applicants
from cohorta.scratch import materialize, scratch_path
from cohorta.sources.models import linear_table, load_cascade, tree_table
from cohorta.sources.tables import read_model_tables, read_rank_table, write_model_tables
from cohorta.streaming.score import read_arrivals, read_scored, score_stream
from cohorta.workload.registry import query
from cohorta.workload.tables import (
    APPLICANTS,
    CASCADE,
    DIGITS,
    RANK_TABLE,
    ROUTE_SQL,
    SCORED,
    STATUS_SQL,
    TERMS,
    TREES,
    applicants,
    linear_sql,
    rank_reference,
    table,
)

INPUTS = ["row_id", "moy_gle", "math"]


def scored(spark, sf_dir, extra=()):
    return score_applicants(applicants(spark, sf_dir, [*INPUTS, *extra]), CASCADE, digits=DIGITS)


def bands_sql(bands, value: str) -> str:
    quoted = [(bound, text.replace("'", "''")) for bound, text in bands]
    cases = " ".join(f"WHEN {value} >= {b} THEN '{t}'" for b, t in quoted[:-1])
    return f"CASE {cases} ELSE '{quoted[-1][1]}' END"


@query(f"""WITH {APPLICANTS} SELECT row_id, CASE WHEN moy_gle <= 100000 THEN 0 ELSE 1 END AS admission,
CASE WHEN math <= 20 THEN 0 ELSE 1 END AS session, CASE WHEN moy_gle <= 350000 THEN 0 ELSE 1 END AS mention
FROM applicants""")
def tree_score(spark, sf_dir):
    df = applicants(spark, sf_dir, INPUTS)
    return df.select("row_id", *[M.tree_decision(TREES[k]).alias(k) for k in M.TREE_KEYS])


@query(f"""WITH {APPLICANTS}, stats AS (SELECT avg(moy_gle) AS m, round_even(stddev_pop(moy_gle), 0) AS s FROM applicants)
SELECT row_id, round_even((moy_gle - m) / s * 1e6, 0) / 1e6 AS z_moy_gle FROM applicants, stats""")
def standardise(spark, sf_dir):
    """Standardise with the mean and deviation of all applicants."""
    df = applicants(spark, sf_dir, ["row_id", "moy_gle"])
    stats = df.agg(F.avg("moy_gle"), F.rint(F.stddev_pop("moy_gle"))).first()
    z = M.standardise(df, [M.Term("moy_gle", 1.0, stats[0], stats[1])])
    return z.select("row_id", M.rounded(F.col("z_moy_gle"), 6).alias("z_moy_gle"))


@query(f"""WITH {APPLICANTS} SELECT row_id, {linear_sql("60.0")} AS score FROM applicants""")
def linear_score(spark, sf_dir):
    df = applicants(spark, sf_dir, INPUTS)
    return df.select("row_id", M.rounded(M.linear_score(CASCADE.models["passable"]), DIGITS).alias("score"))


@query(f"""WITH {SCORED} SELECT row_id, status AS "Prediction_Status", score AS "Score_Predit",
model_key AS "Model_Utilise" FROM scored""")
def cascade_score(spark, sf_dir):
    return scored(spark, sf_dir).drop("moy_gle", "math")


@query(f"""WITH {SCORED} SELECT row_id, score_l1,
CASE WHEN ok THEN status ELSE 'ERREUR' END AS "Prediction_Status", CASE WHEN ok THEN score END AS "Score_Predit",
CASE WHEN ok THEN model_key END AS "Model_Utilise"
FROM (SELECT *, model_key <> 'deuxieme_session' AND score_l1 IS NOT NULL AS ok FROM scored)""")
def score_batch(spark, sf_dir):
    """One model is missing and one field is required: such rows become errors."""
    models = {k: m for k, m in CASCADE.models.items() if k != "deuxieme_session"}
    df = applicants(spark, sf_dir, [*INPUTS, "score_l1"])
    return M.score_batch(df, M.Cascade(TREES, models), required=["score_l1"], digits=DIGITS).drop("moy_gle", "math")


@query(f"""WITH {APPLICANTS} SELECT row_id, moy_gle, math, {linear_sql("50.0")} AS "Score_Predit" FROM applicants""")
def global_linear_score(spark, sf_dir):
    df = applicants(spark, sf_dir, INPUTS)
    return M.global_linear_score(df, M.LinearModel(50.0, TERMS), digits=DIGITS)


# Per-cohort models: each cohort's own mean and deviation, one intercept per route.
COHORT_MODELS = f"""cohort_stats AS (
  SELECT cohort AS model_cohort, avg(moy_gle) AS mean, round_even(stddev_pop(moy_gle), 0) AS scale
  FROM applicants GROUP BY cohort
)"""

# Routes of the third ensemble: other thresholds.
TREES_V3 = {
    "admission": M.Split("moy_gle", 120_000.0, 0, 1),
    "session": M.Split("math", 22.0, 0, 1),
    "mention": M.Split("moy_gle", 330_000.0, 0, 1),
}
ROUTE_V3_SQL = """CASE WHEN moy_gle <= 120000 THEN 'non_admi' WHEN math <= 22 THEN 'deuxieme_session'
     WHEN moy_gle <= 330000 THEN 'passable' ELSE 'mention' END"""
SHIFT_SQL = """CASE model_key WHEN 'deuxieme_session' THEN -1000.0 WHEN 'passable' THEN -5000.0
     WHEN 'mention' THEN -10000.0 ELSE 0.0 END"""
INTERCEPTS_V2 = {"non_admi": 20.0, "deuxieme_session": 35.0, "passable": 60.0, "mention": 85.0}
INTERCEPTS_V3 = {"non_admi": 15.0, "deuxieme_session": 40.0, "passable": 55.0, "mention": 90.0}


def intercept_sql(intercepts) -> str:
    return "CASE model_key " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in intercepts.items()) + " END"


def cohort_statistics(spark, sf_dir):
    """Mean and deviation of each cohort."""
    return applicants(spark, sf_dir, ["cohort", "moy_gle"]).groupBy("cohort").agg(
        F.avg("moy_gle").alias("mean"), F.rint(F.stddev_pop("moy_gle")).alias("scale")
    )


def cohort_models(stats, intercepts):
    """Model table with one model per cohort and route, from what was learned of the cohorts."""
    keys = F.array(*[
        F.struct(F.lit(k).alias("model_key"), F.lit(b).alias("intercept")) for k, b in intercepts.items()
    ])
    terms = F.array(
        F.struct(F.lit("moy_gle").alias("feature"), F.lit(5.0).alias("coef"), F.col("mean"), F.col("scale")),
        F.struct(F.lit("math").alias("feature"), F.lit(3.0).alias("coef"),
                 F.lit(25.0).alias("mean"), F.lit(10.0).alias("scale")),
    )
    per_route = stats.select("cohort", terms.alias("terms"), F.inline(keys))
    return per_route.select("cohort", "model_key", "intercept", F.inline("terms"))


@query(f"""WITH {APPLICANTS}, {COHORT_MODELS}
SELECT row_id, cohort, model_key AS "Model_Utilise", {STATUS_SQL} AS "Prediction_Status",
  {linear_sql(intercept_sql(INTERCEPTS_V2), "mean", "scale")} + {SHIFT_SQL} AS "Score_Predit"
FROM (SELECT *, {ROUTE_SQL} AS model_key FROM applicants JOIN cohort_stats ON cohort = model_cohort)""")
def score_by_cohort_model(spark, sf_dir):
    df = applicants(spark, sf_dir, [*INPUTS, "cohort"])
    models = cohort_models(cohort_statistics(spark, sf_dir), INTERCEPTS_V2)
    out = M.score_by_cohort(df, TREES, models, ["moy_gle", "math"], digits=DIGITS)
    return out.drop("moy_gle", "math")


@query(f"""WITH {SCORED} SELECT row_id, status AS "Prediction_Status", score + {SHIFT_SQL} AS "Score_Predit" FROM scored""")
def status_adjust(spark, sf_dir):
    return M.adjust_by_status(scored(spark, sf_dir)).select("row_id", "Prediction_Status", "Score_Predit")


@query(f"""WITH {SCORED} SELECT row_id, score, least(20.0, score / 120.0 * 20.0) AS normalised FROM scored""", name="normalise_score")
def normalise_scores(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "row_id", F.col("Score_Predit").alias("score"), normalise_score("Score_Predit").alias("normalised")
    )


V1 = f"""{SCORED},
v1_parts AS (
  SELECT *, least(20.0, score / 120.0 * 20.0) AS n,
    CASE status WHEN 'MENTION SUPÉRIEURE' THEN 0.95 WHEN 'PASSABLE' THEN 0.75 WHEN 'DEUXIÈME SESSION' THEN 0.40
         WHEN 'NON ADMIS' THEN 0.10 ELSE 0.0 END::DOUBLE AS w FROM scored
), v1 AS (
  SELECT *, round_even(least(95.0, w * 100.0 * (n / 20.0 * 100.0 / 100.0)) * 100.0, 0) / 100.0 AS probability,
    round_even(n * 100.0, 0) / 100.0 AS normalised_score,
    round_even(n / 20.0 * 100.0 * 100.0, 0) / 100.0 AS score_percentage,
    round_even(w * 100.0 * 100.0, 0) / 100.0 AS base_probability FROM v1_parts
)"""


@query(f"""WITH {V1} SELECT row_id, probability, normalised_score, score_percentage, base_probability,
0.0::DOUBLE AS mention_bonus, 0.0::DOUBLE AS serie_bonus FROM v1""")
def success_probability_v1(spark, sf_dir):
    out = predict.success_probability_v1(scored(spark, sf_dir))
    return out.drop("moy_gle", "math", "Prediction_Status", "Score_Predit", "Model_Utilise")


@query(f"""WITH {V1} SELECT row_id, status, score, probability, score_percentage, base_probability,
0.0::DOUBLE AS mention_bonus, 0.0::DOUBLE AS serie_bonus, {bands_sql(ADVICE_V1, "probability")} AS recommendation FROM v1""")
def predict_v1(spark, sf_dir):
    out = predict.predict_v1(scored(spark, sf_dir), keep=["row_id"])
    parts = ("score_percentage", "base_probability", "mention_bonus", "serie_bonus")
    return out.select("row_id", "status", "score", "probability",
                      *[F.col("details")[p].alias(p) for p in parts], "recommendation")


@query(f"""WITH {V1} SELECT row_id AS student_row_id, moy_gle AS student_moy_gle, status, score, probability,
{bands_sql(ADVICE_V1, "probability")} AS recommendation FROM v1""")
def score_batch_nested(spark, sf_dir):
    """Batch result records, their fields projected for comparison."""
    out = predict.predict_batch(scored(spark, sf_dir), INPUTS)
    return out.select(F.col("student.row_id").alias("student_row_id"),
                      F.col("student.moy_gle").alias("student_moy_gle"), "prediction.*")


V2 = f"""{SCORED}, {RANK_TABLE},
capacity AS (SELECT CAST(2 * count(*) AS DOUBLE) AS seats FROM customer),
v2 AS (
  SELECT s.*, coalesce(rank, 0) AS rank, (seats - coalesce(rank, 0)) / seats * 100.0 AS orientation_probability,
    CASE status WHEN 'NON ADMIS' THEN 0.10 WHEN 'DEUXIÈME SESSION' THEN 0.50 WHEN 'PASSABLE' THEN 0.70
         WHEN 'MENTION SUPÉRIEURE' THEN 0.95 ELSE 0.0 END::DOUBLE * 100.0 AS success_probability
  FROM scored s ASOF LEFT JOIN ranks ON s.score >= ranks.table_score, capacity
)"""


def _capacity(spark, sf_dir) -> int:
    return 2 * table(spark, sf_dir, "customer").count()


@query(f"WITH {V2} SELECT row_id, rank, orientation_probability, success_probability FROM v2")
def success_probability_v2(spark, sf_dir):
    out = predict.success_probability_v2(
        scored(spark, sf_dir), rank_reference(spark, sf_dir), "row_id", _capacity(spark, sf_dir)
    )
    return out.select("row_id", "rank", "orientation_probability", "success_probability")


PREDICT_V2 = f"""WITH {V2} SELECT row_id, status, score, orientation_probability, success_probability,
{bands_sql(ADVICE_ORIENTATION, "orientation_probability")} AS orientation_probability_message,
{bands_sql(ADVICE_SUCCESS, "success_probability")} AS success_probability_message FROM v2"""


@query(PREDICT_V2)
def predict_v2(spark, sf_dir):
    """The flagship: from applicants to both probabilities and messages."""
    return predict.predict_v2(
        scored(spark, sf_dir), rank_reference(spark, sf_dir), "row_id", keep=["row_id"],
        capacity=_capacity(spark, sf_dir),
    )


@query("""SELECT o_orderkey AS row_id, (800.0 - rank) / 800.0 * 100.0 AS probability FROM
(SELECT o_orderkey, floor(o_totalprice / 600.0) AS rank FROM orders)""")
def orientation_probability(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("row_id"),
        orientation_percentage(F.floor(F.col("o_totalprice") / F.lit(600.0))).alias("probability"),
    )


@query(f"""SELECT row_id, p, {bands_sql(ADVICE_V1, "p")} AS message
FROM (SELECT event_id AS row_id, value AS p FROM events)""")
def recommend_v1(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("p"))
    return events.withColumn("message", advice_v1("p"))


@query(f"""SELECT row_id, kind, p, CASE kind WHEN 'orientation' THEN {bands_sql(ADVICE_ORIENTATION, "p")}
WHEN 'success' THEN {bands_sql(ADVICE_SUCCESS, "p")}
ELSE 'Type de probabilité invalide. Veuillez utiliser ''orientation'' ou ''success''.' END AS message
FROM (SELECT event_id AS row_id, value AS p,
  CASE event_type WHEN 'click' THEN 'orientation' WHEN 'view' THEN 'success' ELSE event_type END AS kind FROM events)""")
def recommend_v2(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "orientation").when(
        F.col("event_type") == "view", "success"
    ).otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), kind.alias("kind"), F.col("value").alias("p")
    )
    return events.withColumn("message", advice_v2("p", F.col("kind")))


@query(f"""WITH {SCORED} SELECT row_id, status AS "Prediction_Status", score AS "Score_Predit" FROM scored""")
def model_registry(spark, sf_dir):
    """Score with parameters that were stored as tables and loaded again."""
    folder = scratch_path(spark, "models")
    write_model_tables(linear_table(spark, CASCADE.models), tree_table(spark, CASCADE.trees), folder)
    cascade = load_cascade(spark, folder)
    out = score_applicants(applicants(spark, sf_dir, INPUTS), cascade, digits=DIGITS)
    return out.select("row_id", "Prediction_Status", "Score_Predit")


@query()
def fit_and_score(spark, sf_dir):
    """Fit trees and linear models on the applicants, store, load and score."""
    names = ["moy_gle", "math", "scph", "fr"]
    df = applicants(spark, sf_dir, ["row_id", *names, "score_l1", "resultat", "serie"])
    labels = {
        "admission": (F.col("resultat") != "NON ADMIS").cast("int"),
        "session": (F.col("resultat") == "PASSE").cast("int"),
        "mention": (F.col("score_l1") >= 150_000).cast("int"),
    }
    fitted = fit.fit_cascade(df, names, names, labels, "score_l1")
    folder = scratch_path(spark, "models")
    write_model_tables(linear_table(spark, fitted.models), tree_table(spark, fitted.trees), folder)
    return score_applicants(df.select("row_id", *names), load_cascade(spark, folder))


@query()
def fitted_parameters(spark, sf_dir):
    """The stored parameter table of a global linear model fitted on the applicants."""
    names = ["moy_gle", "math", "scph", "fr"]
    df = applicants(spark, sf_dir, [*names, "score_l1"])
    folder = scratch_path(spark, "models")
    model = fit.fit_linear(df, names, "score_l1")
    write_model_tables(linear_table(spark, {"global": model}), tree_table(spark, {}), folder)
    return read_model_tables(spark, folder)[0].drop("cohort")


@query("""WITH ranks AS (
  SELECT DISTINCT score AS table_score, rank() OVER (ORDER BY score DESC) AS rank
  FROM (SELECT round_even(c_acctbal, 0) / 100.0 AS score FROM customer)
)
SELECT row_id, score, coalesce(rank, 0) AS rank, (800.0 - coalesce(rank, 0)) / 800.0 * 100.0 AS orientation_probability
FROM (SELECT event_id AS row_id, value AS score FROM events) e
ASOF LEFT JOIN ranks ON e.score >= ranks.table_score""")
def stream_score(spark, sf_dir):
    """Event values as arriving scores, ranked against a table learned beforehand."""
    events = table(spark, sf_dir, "events")
    # A pattern: the table may be one file or a folder of files.
    arrivals = read_arrivals(spark, f"{sf_dir}/events.parquet*", events.schema)
    ranks = materialize(rank_reference(spark, sf_dir), "ranks")

    def score(batch):
        named = batch.select(F.col("event_id").alias("row_id"), F.col("value").alias("score"))
        ranked = predict.asof_lookup(named, ranks, "score", "score", "rank", "rank", "row_id")
        return ranked.withColumn("orientation_probability", orientation_percentage("rank"))

    sink = scratch_path(spark, "stream")
    score_stream(arrivals, score, sink, scratch_path(spark, "stream-state")).awaitTermination()
    return read_scored(spark, sink).select("row_id", "score", "rank", as_column("orientation_probability"))


@query(PREDICT_V2)
def stream_predict(spark, sf_dir):
    """Applicants as arriving files: cascade, both probabilities and messages, as for a batch."""
    folder = scratch_path(spark, "arrivals")
    applicants(spark, sf_dir, INPUTS).write.parquet(folder)
    ranks, capacity = materialize(rank_reference(spark, sf_dir), "ranks"), _capacity(spark, sf_dir)

    def score(batch):
        rows = score_applicants(batch, CASCADE, digits=DIGITS)
        return predict.predict_v2(rows, ranks, "row_id", keep=["row_id"], capacity=capacity)

    sink = scratch_path(spark, "stream")
    arrivals = read_arrivals(spark, folder, spark.read.parquet(folder).schema)
    score_stream(arrivals, score, sink, scratch_path(spark, "stream-state")).awaitTermination()
    return read_scored(spark, sink)


@query(f"""WITH {RANK_TABLE} SELECT row_id, score, coalesce(rank, 0) AS rank
FROM (SELECT event_id AS row_id, value AS score FROM events) e
ASOF LEFT JOIN ranks ON e.score >= ranks.table_score""")
def rank_file_lookup(spark, sf_dir):
    """Event values looked up in a rank file with a space before every value."""
    path = scratch_path(spark, "rank-csv")
    spaced = rank_reference(spark, sf_dir).select(
        F.concat(F.lit(" "), F.col("score").cast("string")).alias("Score L1"),
        F.concat(F.lit(" "), F.col("rank").cast("string")).alias(" Rang L1"),
    )
    spaced.write.options(header=True, ignoreLeadingWhiteSpace=False).csv(path)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("score"))
    return predict.asof_lookup(events, read_rank_table(spark, path), "score", "score", "rank", "rank", "row_id")
