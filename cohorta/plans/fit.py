"""Fitting the cascade on a table of applicants with known outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cohorta.functions.scalar import as_column
from cohorta.operators.scoring import TREE_KEYS, Cascade, LinearModel, Split, Term
from cohorta.scratch import materialize


def fit_tree(
    df: DataFrame, features: Sequence[str], label: Column, max_depth: int = 4, seed: int = 7
) -> Split | int:
    """A binary decision tree on the rows whose label is known."""
    data = _vectors(df.withColumn("__label", label.cast("double")).dropna(subset=["__label"]), features)
    model = DecisionTreeClassifier(
        featuresCol="__x", labelCol="__label", maxDepth=max_depth, seed=seed
    ).fit(data)
    return _read_node(model._call_java("rootNode"), list(features))


def _read_node(node, features: list[str]) -> Split | int:
    # A tree has at most 2 ** (max_depth + 1) nodes.
    if node.getClass().getSimpleName() == "LeafNode":
        return int(node.prediction())
    split = node.split()
    return Split(
        features[split.featureIndex()],
        split.threshold(),
        _read_node(node.leftChild(), features),
        _read_node(node.rightChild(), features),
    )


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = df.select("__label", *[filled(f).alias(f) for f in features])
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error").transform(rows)


def filled(feature: str) -> Column:
    """Null and NaN count as 0, as they do when features are prepared: no training row is left out."""
    value = as_column(feature).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def column_stats(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> list:
    """Row count, and mean and population deviation of each feature, per group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(filled(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(filled(f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).collect()


def fit_linear(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    penalty: float = 0.01,
    max_iter: int = 50,
    stats: Row | None = None,
) -> LinearModel:
    """Standardised lasso: population mean and deviation, L1 penalty."""
    rows = df.where(as_column(target).isNotNull())
    stats = stats or column_stats(rows, features)[0]
    means = [stats[f"m{i}"] or 0.0 for i in range(len(features))]
    # A constant feature has deviation 0 and is left unscaled.
    scales = [stats[f"s{i}"] or 1.0 for i in range(len(features))]
    scaled = rows.select(
        as_column(target).cast("double").alias("__label"),
        *[((filled(f) - m) / s).alias(f) for f, m, s in zip(features, means, scales)],
    )
    model = LinearRegression(
        featuresCol="__x", labelCol="__label", elasticNetParam=1.0, regParam=penalty,
        standardization=False, maxIter=max_iter,
    ).fit(_vectors(scaled, features))
    terms = tuple(
        Term(f, float(c), float(m), float(s))
        for f, c, m, s in zip(features, model.coefficients, means, scales)
    )
    return LinearModel(float(model.intercept), terms)


def route_of(labels: Mapping[str, Column]) -> Column:
    """Key of the linear model that a row with known outcomes belongs to; null where a label on the way is."""
    admitted = labels["admission"] == 1
    first_session = admitted & (labels["session"] == 1)
    return (
        F.when(labels["admission"] == 0, "non_admi")
        .when(admitted & (labels["session"] == 0), "deuxieme_session")
        .when(first_session & (labels["mention"] == 0), "passable")
        .when(first_session & (labels["mention"] == 1), "mention")
    )


def fit_cascade(
    df: DataFrame,
    tree_inputs: Sequence[str],
    model_inputs: Sequence[str],
    labels: Mapping[str, Column],
    target: str,
    **tree_options,
) -> Cascade:
    """Fit the three trees, and one linear model per status.

    ``labels`` gives the 0/1 label of each tree: ``admission`` for every row,
    ``session`` among the admitted, ``mention`` among first-session passes.  A
    status without rows gets no model.  The training columns are written once,
    since every fit passes over them several times.
    """
    admitted = labels["admission"] == 1
    first_session = admitted & (labels["session"] == 1)
    route = route_of(labels)
    inputs = sorted({*tree_inputs, *model_inputs})
    training = materialize(
        df.select(
            *[as_column(f) for f in inputs],
            as_column(target).alias("__target"),
            route.alias("__route"),
            labels["admission"].alias("__admission"),
            F.when(admitted, labels["session"]).alias("__session"),
            F.when(first_session, labels["mention"]).alias("__mention"),
        ),
        "training",
    )
    known = training.where(F.col("__target").isNotNull() & F.col("__route").isNotNull())
    stats = {row["__route"]: row for row in column_stats(known, model_inputs, ["__route"])}

    def tree(key: str) -> Split | int:
        return fit_tree(training, tree_inputs, F.col(f"__{key}"), **tree_options)

    def model(key: str) -> LinearModel:
        return fit_linear(known.where(F.col("__route") == key), model_inputs, "__target", stats=stats[key])

    # The fits are independent jobs over one stored table: let the cluster overlap them.
    in_session = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(len(TREE_KEYS) + len(stats)) as pool:
        tree_jobs = {key: pool.submit(in_session(tree), key) for key in TREE_KEYS}
        model_jobs = {key: pool.submit(in_session(model), key) for key in stats}
        trees = {key: job.result() for key, job in tree_jobs.items()}
        models = {key: job.result() for key, job in model_jobs.items()}
    return Cascade(trees, models)
