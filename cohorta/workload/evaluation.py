"""Cohort evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions.scalar import rounded
from cohorta.operators import evaluation as E
from cohorta.operators import scoring as M
from cohorta.operators.features import baseline_prediction
from cohorta.plans.predict import score_applicants
from cohorta.scratch import materialize
from cohorta.workload.registry import query
from cohorta.workload.scoring import (
    COHORT_MODELS,
    INTERCEPTS_V2,
    INTERCEPTS_V3,
    ROUTE_V3_SQL,
    SHIFT_SQL,
    TREES_V3,
    cohort_models,
    cohort_statistics,
    intercept_sql,
)
from cohorta.workload.tables import (
    CASCADE,
    DIGITS,
    ROUTE_SQL,
    SCORED,
    TERMS,
    TREES,
    applicants,
    linear_sql,
)

METHODS = ("average", "first", "min")
NEEDED = ["row_id", "cohort", "resultat", "score_l1", "score_dap", "moy_gle", "math"]

# Series in long form: all models' scores and, repeated per model, the truth.
MODELS_SQL = f"""{SCORED}, {COHORT_MODELS},
by_cohort AS (SELECT * FROM scored JOIN cohort_stats ON cohort = model_cohort),
v3_routed AS (SELECT * REPLACE ({ROUTE_V3_SQL} AS model_key) FROM by_cohort),
series AS (
  SELECT 'ensemble_v1' AS model, cohort, row_id, resultat, score_l1, score AS predicted FROM scored
  UNION ALL SELECT 'ensemble_v2', cohort, row_id, resultat, score_l1,
    {linear_sql(intercept_sql(INTERCEPTS_V2), "mean", "scale")} + {SHIFT_SQL} FROM by_cohort
  UNION ALL SELECT 'ensemble_v3', cohort, row_id, resultat, score_l1,
    {linear_sql(intercept_sql(INTERCEPTS_V3), "mean", "scale")} + {SHIFT_SQL} FROM v3_routed
  UNION ALL SELECT 'global_linear', cohort, row_id, resultat, score_l1, {linear_sql("50.0")} FROM scored
  UNION ALL SELECT 'baseline', cohort, row_id, resultat, score_l1, score_dap FROM scored
)"""


def _rank_sql(score: str, method: str) -> str:
    over = f"PARTITION BY model, cohort, {score} IS NULL ORDER BY {score} DESC"
    rank = {
        "average": f"rank() OVER ({over}) + (count(*) OVER (PARTITION BY model, cohort, {score}) - 1) / 2.0::DOUBLE",
        "min": f"rank() OVER ({over})",
        "first": f"row_number() OVER ({over}, row_id)",
    }[method]
    return f"CASE WHEN {score} IS NOT NULL THEN CAST({rank} AS DOUBLE) END"


RANKED_SQL = f"""{MODELS_SQL},
ranked AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS method, *, {_rank_sql('score_l1', m)} AS true_rank, {_rank_sql('predicted', m)} AS predicted_rank FROM series"
    for m in METHODS)}),
measured AS (
  SELECT model, method, cohort, sqrt(avg(pow(true_rank - predicted_rank, 2.0))) AS rmse,
    coalesce(sum(1.0 / predicted_rank) FILTER (WHERE resultat = 'PASSE'), 0.0) AS mrr_strict,
    coalesce(sum(1.0 / predicted_rank) FILTER (WHERE resultat IS DISTINCT FROM 'NON ADMIS'), 0.0) AS mrr_open,
    count(*) AS n_rows, count(*) FILTER (WHERE true_rank IS NULL OR predicted_rank IS NULL) AS n_errors
  FROM ranked GROUP BY model, method, cohort
)"""

MACRO_SQL = """SELECT model, method, round_even(avg(sqrt(rmse)) * 1e6, 0) / 1e6 AS rank_error,
round_even(avg(mrr_strict) * 1e6, 0) / 1e6 AS mrr_strict, round_even(avg(mrr_open) * 1e6, 0) / 1e6 AS mrr_open,
count(*) AS n_cohorts FROM measured"""


def _six(df, *names):
    return df.withColumns({n: rounded(F.col(n), 6) for n in names})


def ensemble_v1(df):
    return score_applicants(df, CASCADE, digits=DIGITS)


def by_cohort(stats, trees, intercepts):
    """Predictor with linear models of each cohort's own."""
    models = cohort_models(stats, intercepts)
    return lambda df: M.score_by_cohort(df, trees, models, ["moy_gle", "math"], digits=DIGITS)


def global_linear(df):
    return M.global_linear_score(df, M.LinearModel(50.0, TERMS), digits=DIGITS)


def predictors(spark, sf_dir):
    # Both ensembles by cohort start from the same statistics: learn them once.
    stats = materialize(cohort_statistics(spark, sf_dir), "statistics")
    return {
        "ensemble_v1": ensemble_v1,
        "ensemble_v2": by_cohort(stats, TREES, INTERCEPTS_V2),
        "ensemble_v3": by_cohort(stats, TREES_V3, INTERCEPTS_V3),
        "global_linear": global_linear,
        "baseline": baseline_prediction,
    }


@query(f"""WITH {RANKED_SQL} SELECT cohort, round_even(sqrt(rmse) * 1e6, 0) / 1e6 AS rank_error,
round_even(rmse * 1e6, 0) / 1e6 AS rmse, n_rows, n_errors
FROM measured WHERE model = 'baseline' AND method = 'average'""")
def eval_rank_error(spark, sf_dir):
    df = baseline_prediction(applicants(spark, sf_dir, NEEDED))
    out = E.evaluate_predictions(df, ("average",))
    return _six(out.select("cohort", "rank_error", "rmse", "n_rows", "n_errors"), "rank_error", "rmse")


@query(f"""WITH {RANKED_SQL} SELECT cohort, round_even(mrr_strict * 1e6, 0) / 1e6 AS mrr_strict,
round_even(mrr_open * 1e6, 0) / 1e6 AS mrr_open FROM measured WHERE model = 'ensemble_v1' AND method = 'average'""")
def eval_mrr(spark, sf_dir):
    out = E.evaluate_predictions(ensemble_v1(applicants(spark, sf_dir, NEEDED)), ("average",))
    return _six(out.select("cohort", "mrr_strict", "mrr_open"), "mrr_strict", "mrr_open")


@query(f"WITH {RANKED_SQL} {MACRO_SQL} WHERE model = 'baseline' GROUP BY model, method")
def eval_macro(spark, sf_dir):
    df = baseline_prediction(applicants(spark, sf_dir, NEEDED))
    out = E.macro_average(E.evaluate_predictions(df, METHODS, model="baseline"))
    return _six(out, "rank_error", "mrr_strict", "mrr_open")


@query(f"WITH {RANKED_SQL} {MACRO_SQL} WHERE model = 'ensemble_v2' AND method = 'average' GROUP BY model, method")
def evaluate_model(spark, sf_dir):
    predictor = by_cohort(cohort_statistics(spark, sf_dir), TREES, INTERCEPTS_V2)
    out = E.evaluate_model(applicants(spark, sf_dir, NEEDED), predictor, suffix="ensemble_v2")
    return _six(out, "rank_error", "mrr_strict", "mrr_open")


@query(f"WITH {RANKED_SQL} {MACRO_SQL} GROUP BY model, method")
def evaluate_grid(spark, sf_dir):
    out = E.evaluate_grid(applicants(spark, sf_dir, NEEDED), predictors(spark, sf_dir), METHODS)
    return _six(out, "rank_error", "mrr_strict", "mrr_open")
