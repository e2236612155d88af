"""Cohort evaluation: rank truth and prediction, measure error and reciprocal ranks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.scalar import as_column
from cohorta.operators.ranking import add_ranks
from cohorta.schema import NON_ADMIS, PASSE
from cohorta.scratch import materialize

# Any function that adds ``Score_Predit`` to a frame is a predictor.
Predictor = Callable[[DataFrame], DataFrame]


def rank_error(truth: Column, predicted: Column) -> tuple[Column, Column]:
    """The evaluated error, the square root of the RMSE, and the plain RMSE.

    Pairs with a missing rank are left out.
    """
    rmse = F.sqrt(F.avg(F.pow(truth - predicted, F.lit(2.0))))
    return F.sqrt(rmse), rmse


def reciprocal_ranks(predicted: Column, passed: Column, admitted: Column) -> tuple[Column, Column]:
    """Sums of reciprocal ranks: over passes, and over all but the not admitted."""
    strict = F.sum(F.when(passed, F.lit(1.0) / predicted))
    loose = F.sum(F.when(admitted, F.lit(1.0) / predicted))
    return F.coalesce(strict, F.lit(0.0)), F.coalesce(loose, F.lit(0.0))


def rank_all(
    df: DataFrame,
    scores: Mapping[str, str],
    methods: Sequence[str],
    truth: str = "score_l1",
    cohort: str = "cohort",
    row_id: str = "row_id",
    result: str = "resultat",
    slices: int | None = None,
) -> DataFrame:
    """Rank truth and every model's score by cohort, side by side.

    ``scores`` maps model names to score columns.  The scores are written once,
    since ranking reads its input more than once, and so are the ranks of the
    truth beside them; all models are then ranked over one shuffle, through which
    these ranks are carried.  Returns one row per applicant, model and tie method:
    ``true_rank`` and ``predicted_rank``.
    """
    outcome = as_column(result)
    columns = {f"__p{i}": c for i, c in enumerate(scores.values())}
    wide = materialize(
        df.select(
            as_column(cohort).alias("cohort"),
            as_column(row_id).alias("row_id"),
            F.coalesce(outcome == PASSE, F.lit(False)).alias("passed"),
            (~outcome.eqNullSafe(F.lit(NON_ADMIS))).alias("admitted"),
            as_column(truth).cast("double").alias("__truth"),
            *[as_column(c).cast("double").alias(name) for name, c in columns.items()],
        ),
        "scores",
    )
    options = {"methods": methods, "slices": slices}
    ranked = materialize(add_ranks(wide, "__truth", "row_id", ["cohort"], prefix="__t_", **options), "truth")
    pairs = F.array(*[
        F.struct(F.lit(model).alias("model"), F.col(name).alias("score"))
        for model, name in zip(scores, columns)
    ])
    true_ranks = [f"__t_{m}" for m in methods]
    predicted = ranked.select("cohort", "row_id", "passed", "admitted", *true_ranks, F.inline(pairs))
    predicted = add_ranks(predicted, "score", "row_id", ["model", "cohort"], prefix="__p_", **options)
    cells = [
        F.struct(
            F.lit(m).alias("method"),
            F.col(f"__t_{m}").cast("double").alias("true_rank"),
            F.col(f"__p_{m}").cast("double").alias("predicted_rank"),
        )
        for m in methods
    ]
    return predicted.select(
        "cohort", "row_id", "passed", "admitted", "model", F.inline(F.array(*cells))
    )


def measure(ranked: DataFrame, by: Sequence[str] = ("model", "method", "cohort")) -> DataFrame:
    """Metrics per group of ranked pairs."""
    error, rmse = rank_error(F.col("true_rank"), F.col("predicted_rank"))
    strict, loose = reciprocal_ranks(F.col("predicted_rank"), F.col("passed"), F.col("admitted"))
    paired = F.col("true_rank").isNotNull() & F.col("predicted_rank").isNotNull()
    return ranked.groupBy(*by).agg(
        error.alias("rank_error"),
        rmse.alias("rmse"),
        strict.alias("mrr_strict"),
        loose.alias("mrr_open"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(~paired, 1)).alias("n_errors"),
    )


def macro_average(metrics: DataFrame, by: Sequence[str] = ("model", "method")) -> DataFrame:
    """Plain mean of the metrics over the cohorts."""
    names = ("rank_error", "mrr_strict", "mrr_open")
    return metrics.groupBy(*by).agg(
        *[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("n_cohorts")
    )


def evaluate_predictions(
    df: DataFrame,
    methods: Sequence[str] = ("average",),
    prediction: str = "Score_Predit",
    model: str = "model",
    **columns: str,
) -> DataFrame:
    """Metrics by cohort of one already scored frame."""
    return measure(rank_all(df, {model: prediction}, methods, **columns))


def evaluate_model(
    df: DataFrame,
    predictor: Predictor,
    suffix: str = "",
    methods: Sequence[str] = ("average",),
    **columns: str,
) -> DataFrame:
    """Predict, rank, measure, and average over cohorts."""
    scored = df.transform(predictor)
    return macro_average(evaluate_predictions(scored, methods, model=suffix, **columns))


def evaluate_grid(
    df: DataFrame,
    predictors: Mapping[str, Predictor],
    methods: Sequence[str] = ("average", "first", "min"),
    prediction: str = "Score_Predit",
    **columns: str,
) -> DataFrame:
    """Every model under every tie method: macro averages.

    The predictors run one after the other as projections over the same frame.
    """
    base = df.columns
    scores = {}
    for i, (name, predictor) in enumerate(predictors.items()):
        scored = df.transform(predictor)
        scores[name] = f"__score_{i}"
        df = scored.select(
            *[as_column(c) for c in base],
            *[as_column(c) for c in list(scores.values())[:-1]],
            as_column(prediction).alias(scores[name]),
        )
    return macro_average(measure(rank_all(df, scores, methods, **columns)))
