"""Fitting one linear model for each group of rows, all groups in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.scalar import as_column
from cohorta.plans.fit import filled, route_of
from cohorta.scratch import materialize


def group_moments(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """What a linear fit needs to know of each group, one row per group.

    ``n``, ``target_mean``, ``means`` and ``scales`` (population deviations, 1 for a constant
    feature), ``covariances`` among the standardised features (one array per feature) and
    ``with_target``. The rows are read once and summed up before they are moved; the
    sums grow with the square of the features, not with the rows. Rows without a
    target are left out, null and NaN features count as 0.
    """
    x = [f"__x{i}" for i in range(len(features))]
    rows = df.where(as_column(target).isNotNull()).select(
        *[as_column(c).alias(f"__by{i}") for i, c in enumerate(by)],
        as_column(target).cast("double").alias("__y"),
        *[filled(f).alias(name) for f, name in zip(features, x)],
    )
    places = range(len(x))
    sums = rows.groupBy(*[f"__by{i}" for i in range(len(by))]).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__y").alias("target_mean"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[F.covar_pop(c, "__y").alias(f"y{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in places for j in places if i <= j],
    )
    # A constant feature has deviation 0 and is left unscaled.
    scale = [F.when(F.col(f"c{i}_{i}") > 0, F.sqrt(f"c{i}_{i}")).otherwise(F.lit(1.0)) for i in places]
    covariance = [
        [F.col(f"c{min(i, j)}_{max(i, j)}") / (scale[i] * scale[j]) for j in places] for i in places
    ]
    return sums.select(
        *[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)],
        "n",
        "target_mean",
        F.array(*[F.col(f"m{i}") for i in places]).alias("means"),
        F.array(*scale).alias("scales"),
        F.array(*[F.array(*row) for row in covariance]).alias("covariances"),
        F.array(*[F.col(f"y{i}") / s for i, s in enumerate(scale)]).alias("with_target"),
    )


def lasso_coefficients(penalty: float, sweeps: int = 2000, tolerance: float = 1e-13) -> Column:
    """Coefficients of the standardised features, from the columns of ``group_moments``.

    Coordinate descent on the group's small matrix: a sweep sets one coefficient after the
    other to its best value given the others. It ends when a sweep changes none by more
    than ``tolerance`` times the greatest covariance with the target, or after ``sweeps``.
    """
    covariances, with_target = F.col("covariances"), F.col("with_target")
    limit = F.lit(tolerance) * F.array_max(F.transform(with_target, F.abs))

    def better(coefs: Column, j: Column) -> Column:
        row = F.get(covariances, j)
        own = F.get(row, j)
        explained = F.aggregate(F.zip_with(row, coefs, lambda c, b: c * b), F.lit(0.0), lambda a, v: a + v)
        rest = F.get(with_target, j) - explained + own * F.get(coefs, j)
        shrunk = F.signum(rest) * F.greatest(F.abs(rest) - F.lit(float(penalty)), F.lit(0.0))
        best = F.when(own > 0, shrunk / own).otherwise(F.lit(0.0))
        return F.transform(coefs, lambda b, i: F.when(i == j, best).otherwise(b))

    def sweep(state: Column, _) -> Column:
        after = F.aggregate(F.sequence(F.lit(0), F.size(with_target) - 1), state["coefs"], better)
        moved = F.zip_with(after, state["coefs"], lambda a, b: F.abs(a - b))
        following = F.transform(
            F.array(after), lambda a: F.struct(a.alias("coefs"), (F.array_max(moved) <= limit).alias("done"))
        )
        return F.when(state["done"], state).otherwise(F.get(following, F.lit(0)))

    start = F.struct(F.transform(with_target, lambda _: F.lit(0.0)).alias("coefs"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, sweep, lambda end: end["coefs"])


def fit_by_group(
    df: DataFrame, features: Sequence[str], target: str, by: Sequence[str], penalty: float = 0.01
) -> DataFrame:
    """A standardised lasso for each group, as rows of a model table.

    (by..., ord, feature, coef, mean, scale, intercept): what ``score_with_model_table``
    joins. Least squares where ``penalty`` is 0. Rows of a group are read once, and groups
    are solved where their sums are: neither meets in the driver. A null key is a group.
    """
    if not features:
        raise ValueError("a linear model needs a feature")
    moments = materialize(group_moments(df, features, target, by), "moments")
    names = F.array(*[F.lit(f) for f in features])
    solved = moments.select(
        *[f"`{c}`" for c in by], F.col("target_mean").alias("intercept"),
        F.arrays_zip(
            names.alias("feature"), lasso_coefficients(penalty).alias("coef"), F.col("means").alias("mean"),
            F.col("scales").alias("scale"),
        ).alias("terms"),
    )
    terms = solved.select(*[f"`{c}`" for c in by], "intercept", F.posexplode("terms").alias("ord", "t"))
    return terms.select(*[f"`{c}`" for c in by], "ord", "t.feature", "t.coef", "t.mean", "t.scale", "intercept")


def fit_cohort_models(
    df: DataFrame,
    features: Sequence[str],
    labels: Mapping[str, Column],
    target: str,
    cohort: str = "cohort",
    penalty: float = 0.01,
) -> DataFrame:
    """The linear models of all cohorts and routes: a model table with keys (cohort, model_key).

    ``labels`` are those of ``fit_cascade``. A route without rows in a cohort gets no model there.
    """
    inputs = df.select(
        as_column(cohort).alias("cohort"), route_of(labels).alias("model_key"), as_column(target).alias("__target"),
        *[as_column(f) for f in features],
    )
    return fit_by_group(inputs.where(F.col("model_key").isNotNull()), features, "__target", ["cohort", "model_key"], penalty)
