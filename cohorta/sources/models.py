"""Model parameters between tables and the objects that become expressions."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from cohorta.operators.scoring import MODEL_STATUS, TREE_KEYS, Cascade, LinearModel, Split, Term, Tree
from cohorta.operators.trees import TreeArrays
from cohorta.sources.tables import MODEL_TABLE_SCHEMA, TREE_TABLE_SCHEMA, read_model_tables

# Coefficients become expressions in the plan; larger sets are joined as a table.
MAX_PARAMETERS = 5_000
# Trees of up to so many nodes become conditionals, larger ones arrays; all trees of a
# cascade together may have so many nodes in the driver and the plan.
MAX_SPLITS = 255
MAX_NODES = 1_000_000


def linear_rows(models: Mapping[str, LinearModel], cohort: str | None = None) -> list[tuple]:
    """Rows of the linear model table; a model without terms keeps one row."""
    rows = []
    for key, model in models.items():
        for i, t in enumerate(model.terms):
            rows.append((cohort, key, i, t.feature, t.coef, t.mean, t.scale, model.intercept))
        if not model.terms:
            rows.append((cohort, key, 0, None, None, None, None, model.intercept))
    return rows


def linear_table(spark: SparkSession, models: Mapping[str, LinearModel], cohort: str | None = None) -> DataFrame:
    return spark.createDataFrame(linear_rows(models, cohort), MODEL_TABLE_SCHEMA)


def tree_rows(trees: Mapping[str, Tree]) -> list[tuple]:
    """Rows of the tree table: nodes numbered from the root (0) down."""
    rows: list[tuple] = []

    def add(key: str, node: Split | int, number: int, free: int) -> int:
        if isinstance(node, int):
            rows.append((key, number, None, None, None, None, node))
            return free
        left, right = free, free + 1
        rows.append((key, number, node.feature, float(node.threshold), left, right, None))
        return add(key, node.right, right, add(key, node.left, left, free + 2))

    for key, root in trees.items():
        if isinstance(root, TreeArrays):
            rows += [(key, *row.values()) for row in root.rows()]
        else:
            add(key, root, 0, 1)
    return rows


def tree_table(spark: SparkSession, trees: Mapping[str, Tree]) -> DataFrame:
    return spark.createDataFrame(tree_rows(trees), TREE_TABLE_SCHEMA)


def _bounded_rows(table: DataFrame, most: int, otherwise: str) -> list:
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} parameters: {otherwise}")
    return rows


def trees_from_table(table: DataFrame) -> dict[str, Tree]:
    """Small trees as conditionals, large ones as arrays."""
    nodes: dict[str, dict[int, object]] = {}
    for row in _bounded_rows(table, MAX_NODES, "walk the table itself with score_tree_table"):
        nodes.setdefault(row["model_key"], {})[row["node"]] = row

    def build(key: str, number: int) -> Split | int:
        row = nodes[key][number]
        if row["feature"] is None:
            return row["prediction"]
        return Split(row["feature"], row["threshold"], build(key, row["left"]), build(key, row["right"]))

    return {
        key: build(key, 0) if len(rows) <= MAX_SPLITS else TreeArrays.from_nodes(rows.values()) for key, rows in nodes.items()
    }


def models_from_table(table: DataFrame) -> dict[str, LinearModel]:
    by_key: dict[str, list] = {}
    for row in _bounded_rows(table, MAX_PARAMETERS, "score with score_with_model_table"):
        by_key.setdefault(row["model_key"], []).append(row)
    models = {}
    for key, rows in by_key.items():
        terms = tuple(
            Term(r["feature"], r["coef"], r["mean"], r["scale"])
            for r in sorted(rows, key=lambda r: r["ord"])
            if r["feature"] is not None
        )
        models[key] = LinearModel(rows[0]["intercept"], terms)
    return models


def load_cascade(spark: SparkSession, folder: str, cohort: str | None = None) -> Cascade:
    """Cascade from stored parameters.

    A missing linear model is reported and its rows become errors; a missing
    tree is fatal.
    """
    linear, trees = read_model_tables(spark, folder)
    linear = linear.where(linear["cohort"].eqNullSafe(cohort))
    models = models_from_table(linear)
    found = {k: v for k, v in trees_from_table(trees).items() if k in TREE_KEYS}
    absent = [k for k in MODEL_STATUS if k not in models]
    if absent:
        warnings.warn(f"linear models not found: {absent}", stacklevel=2)
    return Cascade(found, {k: m for k, m in models.items() if k in MODEL_STATUS})
