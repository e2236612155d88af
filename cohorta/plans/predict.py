"""From applicants to statuses, scores, probabilities, ranks and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.functions.scalar import (
    ADVICE_ORIENTATION,
    ADVICE_SUCCESS,
    CAPACITY,
    MENTION_BONUSES,
    PROBABILITY_CAP,
    SCORE_MAX,
    SERIE_BONUSES,
    STATUS_WEIGHTS_V1,
    STATUS_WEIGHTS_V2,
    advice_v1,
    as_column,
    banded,
    lookup,
    normalise_score,
    orientation_percentage,
    rounded,
    score_percentage,
    success_percentage,
)
from cohorta.operators.asof import SMALL_TABLE_ROWS, asof_lookup
from cohorta.operators.features import FeatureStats, linear_features, tree_features
from cohorta.operators.scoring import Cascade, score_batch
from cohorta.plans.frozen import PreparedRanks


def score_applicants(
    df: DataFrame,
    cascade: Cascade,
    stats: FeatureStats | None = None,
    tree_stats: FeatureStats | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Prepare the features of applicants and append status, score and model.

    Only features the cascade uses are computed.  A tree input and a linear
    input of one name may differ in meaning (a code, a number), hence prefixes.
    Without statistics every applicant is prepared on their own, and the whole
    step is a projection.
    """
    columns = df.columns
    trees = tree_features(
        df, tree_stats, features=cascade.tree_inputs(), keep=columns, prefix="__tree_"
    )
    inputs = linear_features(
        trees, cascade.model_inputs(), stats, keep=trees.columns, prefix="__line_"
    )
    scored = score_batch(inputs, cascade.prefixed("__tree_", "__line_"), digits=digits)
    answers = ["Prediction_Status", "Score_Predit", "Model_Utilise"]
    return scored.select(*[as_column(c) for c in [*columns, *answers]])


def success_probability_v1(
    scored: DataFrame,
    score_max: float = SCORE_MAX,
    cap: float = PROBABILITY_CAP,
    bonuses: bool = False,
    mention: str = "mention",
    serie: str = "serie",
) -> DataFrame:
    """First success probability and its parts, rounded to two decimals.

    The bonuses by mention and series are 0 unless asked for.
    """
    normalised = normalise_score("Score_Predit", score_max)
    percentage = score_percentage(normalised)
    base = lookup("Prediction_Status", STATUS_WEIGHTS_V1)
    mention_bonus = lookup(mention, MENTION_BONUSES) if bonuses else F.lit(0.0)
    serie_bonus = lookup(serie, SERIE_BONUSES) if bonuses else F.lit(0.0)
    probability = success_percentage(base, percentage, mention_bonus + serie_bonus, cap)
    return scored.withColumns({
        "probability": rounded(probability, 2),
        "normalised_score": rounded(normalised, 2),
        "score_percentage": rounded(percentage, 2),
        "base_probability": rounded(base * F.lit(100.0), 2),
        "mention_bonus": rounded(mention_bonus * F.lit(100.0), 2),
        "serie_bonus": rounded(serie_bonus * F.lit(100.0), 2),
    })


def success_probability_v2(
    scored: DataFrame,
    rank_table: DataFrame | PreparedRanks,
    row_id: str,
    capacity: int = CAPACITY,
    table_score: str = "score",
    table_rank: str = "rank",
    small_rows: int = SMALL_TABLE_ROWS,
    miss: int | str | None = 0,
) -> DataFrame:
    """Success probability by status, and orientation probability by historic rank.

    A score below the whole table gets rank 0, hence 100 percent, unless ``miss`` says
    otherwise (``"last"``: the last rank; prepared ranks know theirs).  A table that serves
    more than once should be prepared; then nothing runs but the lookup.
    """
    if isinstance(rank_table, PreparedRanks):
        ranked = rank_table.lookup(scored, "Score_Predit", "rank")
    else:
        ranked = asof_lookup(
            scored, rank_table, "Score_Predit", table_score, table_rank, "rank", row_id, miss=miss, small_rows=small_rows
        )
    return ranked.withColumns({
        "orientation_probability": orientation_percentage("rank", capacity),
        "success_probability": lookup("Prediction_Status", STATUS_WEIGHTS_V2) * F.lit(100.0),
    })


def predict_v1(scored: DataFrame, keep: Sequence[str] = (), **options) -> DataFrame:
    """Status, score, probability, details and recommendation per applicant."""
    parts = ("score_percentage", "base_probability", "mention_bonus", "serie_bonus")
    details = F.create_map(*[x for p in parts for x in (F.lit(p), F.col(p))])
    return success_probability_v1(scored, **options).select(
        *[as_column(k) for k in keep],
        F.col("Prediction_Status").alias("status"),
        F.col("Score_Predit").alias("score"),
        "probability",
        details.alias("details"),
        advice_v1("probability").alias("recommendation"),
    )


def predict_v2(
    scored: DataFrame, rank_table: DataFrame | PreparedRanks, row_id: str, keep: Sequence[str] = (), **options
) -> DataFrame:
    """Status, score, both probabilities and both messages per applicant."""
    return success_probability_v2(scored, rank_table, row_id, **options).select(
        *[as_column(k) for k in keep],
        F.col("Prediction_Status").alias("status"),
        F.col("Score_Predit").alias("score"),
        "orientation_probability",
        "success_probability",
        banded("orientation_probability", ADVICE_ORIENTATION).alias("orientation_probability_message"),
        banded("success_probability", ADVICE_SUCCESS).alias("success_probability_message"),
    )


def predict_batch(scored: DataFrame, inputs: Sequence[str], **options) -> DataFrame:
    """Each input row under ``student`` and its result under ``prediction``."""
    answer = F.struct(
        F.col("Prediction_Status").alias("status"),
        F.col("Score_Predit").alias("score"),
        F.col("probability"),
        advice_v1("probability").alias("recommendation"),
    )
    return success_probability_v1(scored, **options).select(
        F.struct(*[as_column(c) for c in inputs]).alias("student"), answer.alias("prediction")
    )
