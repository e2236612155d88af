"""Model scoring: trees and standardised linear models as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.scalar import (
    DEUXIEME_SESSION,
    ERREUR,
    MENTION_SUPERIEURE,
    NON_ADMIS,
    PASSABLE,
    STATUS_SHIFTS,
    as_column,
    lookup,
    rounded,
)
from cohorta.operators.features import require_columns
from cohorta.operators.trees import TreeArrays
from cohorta.scratch import materialize

# Status that belongs to each linear model.
MODEL_STATUS = {
    "non_admi": NON_ADMIS,
    "deuxieme_session": DEUXIEME_SESSION,
    "passable": PASSABLE,
    "mention": MENTION_SUPERIEURE,
}
TREE_KEYS = ("admission", "session", "mention")

# A model table of more bytes than this is joined instead of broadcast.
MODEL_TABLE_BYTES = 64 << 20


@dataclass(frozen=True)
class Split:
    """Decision node: at or below the threshold go left, above it right."""

    feature: str
    threshold: float
    left: Split | int
    right: Split | int


# A small tree is a nested conditional, a large one a set of arrays.
Tree = Split | TreeArrays | int


@dataclass(frozen=True)
class Term:
    feature: str
    coef: float
    mean: float = 0.0
    scale: float = 1.0


@dataclass(frozen=True)
class LinearModel:
    """``intercept + sum(coef * (x - mean) / scale)``."""

    intercept: float
    terms: tuple[Term, ...]

    @property
    def features(self) -> list[str]:
        return [t.feature for t in self.terms]


@dataclass(frozen=True)
class Cascade:
    """Three trees that route a row, and one linear model per route."""

    trees: Mapping[str, Tree]
    models: Mapping[str, LinearModel]

    def __post_init__(self) -> None:
        missing = set(TREE_KEYS) - set(self.trees)
        if missing:
            raise ValueError(f"missing trees: {sorted(missing)}")

    def tree_inputs(self) -> list[str]:
        return sorted({name for tree in self.trees.values() for name in split_features(tree)})

    def model_inputs(self) -> list[str]:
        return sorted({name for model in self.models.values() for name in model.features})

    def prefixed(self, tree_prefix: str, model_prefix: str) -> Cascade:
        """The same cascade over renamed inputs."""
        trees = {k: prefix_tree(t, tree_prefix) for k, t in self.trees.items()}
        models = {
            k: LinearModel(
                m.intercept, tuple(replace(t, feature=model_prefix + t.feature) for t in m.terms)
            )
            for k, m in self.models.items()
        }
        return Cascade(trees, models)


def split_features(node: Tree) -> set[str]:
    if isinstance(node, int):
        return set()
    if isinstance(node, TreeArrays):
        return set(node.features)
    return {node.feature} | split_features(node.left) | split_features(node.right)


def prefix_tree(node: Tree, prefix: str) -> Tree:
    if isinstance(node, int):
        return node
    if isinstance(node, TreeArrays):
        return node.prefixed(prefix)
    return Split(
        prefix + node.feature, node.threshold, prefix_tree(node.left, prefix), prefix_tree(node.right, prefix)
    )


def tree_decision(node: Tree) -> Column:
    """The 0/1 answer of a tree, as one expression; null if a value on the way is null or NaN."""
    if isinstance(node, int):
        return F.lit(node)
    if isinstance(node, TreeArrays):
        return node.decision()
    value, threshold = as_column(node.feature), F.lit(float(node.threshold))
    return F.when(value <= threshold, tree_decision(node.left)).when(
        (value > threshold) & ~F.isnan(value), tree_decision(node.right)
    )


def standardised(term: Term) -> Column:
    # A scale of 0 counts as 1, as when the scaler is fitted on a constant.
    return (as_column(term.feature) - F.lit(term.mean)) / F.lit(term.scale or 1.0)


def linear_score(model: LinearModel) -> Column:
    score = F.lit(model.intercept)
    for term in model.terms:
        score = score + F.lit(term.coef) * standardised(term)
    return score


def standardise(df: DataFrame, terms: Sequence[Term], prefix: str = "z_") -> DataFrame:
    """Add the standardised value of each term's feature."""
    return df.withColumns({prefix + t.feature: standardised(t) for t in terms})


def route(trees: Mapping[str, Tree]) -> Column:
    """Key of the linear model that scores the row; null if a tree on the way has no answer."""
    admission, session, mention = (tree_decision(trees[k]) for k in TREE_KEYS)
    passed = F.when(mention == 0, F.lit("passable")).when(mention != 0, F.lit("mention"))
    admitted = F.when(session == 0, F.lit("deuxieme_session")).when(session != 0, passed)
    return F.when(admission == 0, F.lit("non_admi")).when(admission != 0, admitted)


def score_batch(
    df: DataFrame,
    cascade: Cascade,
    required: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """Append status, score and model of every row in one narrow projection.

    A row that cannot be scored (no model for its route, a required value
    missing, or an input that its trees or its model need null or NaN) is marked
    as an error and the others go on.
    """
    routed = df.withColumn("__route", route(cascade.trees))
    score = F.lit(None).cast("double")
    for key, model in cascade.models.items():
        score = F.when(F.col("__route") == key, linear_score(model)).otherwise(score)
    if digits is not None:
        score = rounded(score, digits)
    usable = score.isNotNull() & ~F.isnan(score)
    for name in required:
        usable = usable & as_column(name).isNotNull()
    status = F.lit(None).cast("string")
    for key in cascade.models:
        status = F.when(F.col("__route") == key, F.lit(MODEL_STATUS[key])).otherwise(status)
    return routed.withColumns({
        "Prediction_Status": F.when(usable, status).otherwise(F.lit(ERREUR)),
        "Score_Predit": F.when(usable, score),
        "Model_Utilise": F.when(usable, F.col("__route")),
    }).drop("__route")


def adjust_by_status(
    df: DataFrame,
    shifts: Mapping[str, float] = STATUS_SHIFTS,
    status: str = "Prediction_Status",
    score: str = "Score_Predit",
) -> DataFrame:
    """Shift the score by status; other statuses keep theirs."""
    return df.withColumn(score, as_column(score) + lookup(status, shifts))


def global_linear_score(
    df: DataFrame, model: LinearModel, out: str = "Score_Predit", digits: int | None = None
) -> DataFrame:
    """One linear model for all rows; its features must all be present."""
    score = linear_score(model)
    score = rounded(score, digits) if digits is not None else score
    return require_columns(df, model.features).withColumn(out, score)


def score_with_model_table(
    df: DataFrame,
    models: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    out: str = "Score_Predit",
    digits: int | None = None,
    max_broadcast_bytes: int = MODEL_TABLE_BYTES,
) -> DataFrame:
    """Score each row with the linear model its key columns select.

    ``models`` has one row per key and feature: the keys, ``feature``, ``coef``,
    ``mean``, ``scale`` and ``intercept``.  It is turned into one row per key;
    a feature the model does not use counts nothing.  No model, no score; nor
    has a row with a null or NaN input of its model.
    A model with a feature that is not listed raises.  ``models`` is computed once.
    """
    unlisted = F.min(F.when(~F.col("feature").isin(*features), F.col("feature")))
    picked = [F.first("intercept").alias("__b"), unlisted.alias("__unlisted")]
    for i, name in enumerate(features):
        here = F.col("feature") == name
        picked += [F.max(F.when(here, F.col(c))).alias(f"__{c}{i}") for c in ("coef", "mean", "scale")]
    wide = materialize(models.groupBy(*keys).agg(*picked), "models")
    found = wide.agg(F.count(F.lit(1)).alias("n"), F.min("__unlisted").alias("unlisted")).first()
    if found["unlisted"] is not None:
        raise ValueError(f"a model uses a feature that is not listed: {found['unlisted']!r}")
    wide = wide.drop("__unlisted")
    # A fixed part for a row's keys, and eight bytes for each number.
    if found["n"] * (64 + 8 * len(wide.columns)) <= max_broadcast_bytes:
        wide = F.broadcast(wide)
    joined = df.join(wide, list(keys), "left")
    score = F.col("__b")
    for i, name in enumerate(features):
        scale = F.when(F.col(f"__scale{i}") == 0, F.lit(1.0)).otherwise(F.col(f"__scale{i}"))
        z = (as_column(name) - F.col(f"__mean{i}")) / scale
        coef = F.col(f"__coef{i}")
        score = score + F.when(coef.isNull(), F.lit(0.0)).otherwise(coef * z)
    score = rounded(score, digits) if digits is not None else score
    return joined.withColumn(out, F.when(~F.isnan(score), score)).drop(*[c for c in wide.columns if c.startswith("__")])


def score_by_cohort(
    df: DataFrame,
    trees: Mapping[str, Tree],
    models: DataFrame,
    features: Sequence[str],
    cohort: str = "cohort",
    shifts: Mapping[str, float] | None = STATUS_SHIFTS,
    digits: int | None = None,
) -> DataFrame:
    """Cascade whose linear models differ by cohort, then the status shifts."""
    routed = df.withColumn("model_key", route(trees))
    scored = score_with_model_table(routed, models, features, [cohort, "model_key"], digits=digits)
    known = F.col("Score_Predit").isNotNull()
    status = F.lit(None).cast("string")
    for key, name in MODEL_STATUS.items():
        status = F.when(F.col("model_key") == key, F.lit(name)).otherwise(status)
    scored = scored.withColumns({
        "Prediction_Status": F.when(known, status).otherwise(F.lit(ERREUR)),
        "Model_Utilise": F.when(known, F.col("model_key")),
    }).drop("model_key")
    return adjust_by_status(scored, shifts) if shifts else scored
