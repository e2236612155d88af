"""Exact decision trees: every distinct value is a possible threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators.trees import TreeArrays, constant_array
from cohorta.plans.fit import filled
from cohorta.scratch import materialize

# Slices an order of values is cut into, so that no task holds all of one feature.
MOST_SLICES = 256
# A split must raise the score of a node by more than rounding does.
LEAST_GAIN = 1e-9


def _purity(positive: Column, rows: Column) -> Column:
    """Sum of squared class counts over the rows: the greater, the less the Gini impurity."""
    other = rows - positive
    return (positive * positive + other * other) / rows


def _best_splits(training: DataFrame, node: Column, bounds: Sequence[Sequence[float]], min_rows: int) -> list:
    """(node, rows, positive, best split or null) of every node that ``node`` names; others (null) are left out."""
    stacked = training.withColumn("node", node).where(F.col("node").isNotNull()).select(
        "node", "label",
        F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(len(bounds))])).alias("s"),
    )
    cells = stacked.groupBy("node", F.col("s.f").alias("f"), F.col("s.v").alias("v")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("p")
    )
    piece = F.lit(0)
    for i, points in enumerate(bounds):
        if points:
            above = F.size(F.filter(constant_array(points, "double"), lambda b: b < F.col("v")))
            piece = F.when(F.col("f") == i, above).otherwise(piece)
    cells = materialize(cells.withColumn("slice", piece), "cells")

    # One row per node, feature and slice: what lies before it, and the first value after it.
    order = Window.partitionBy("node", "f").orderBy("slice")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("node", "f")
    slices = cells.groupBy("node", "f", "slice").agg(F.sum("n").alias("sn"), F.sum("p").alias("sp"), F.min("v").alias("first"))
    slices = slices.select(
        "node", "f", "slice",
        F.coalesce(F.sum("sn").over(before), F.lit(0.0)).alias("n0"),
        F.coalesce(F.sum("sp").over(before), F.lit(0.0)).alias("p0"),
        F.sum("sn").over(whole).alias("rows"), F.sum("sp").over(whole).alias("positive"),
        F.lead("first").over(order).alias("beyond"),
    )
    inside = Window.partitionBy("node", "f", "slice").orderBy("v")
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.join(slices, ["node", "f", "slice"]).select(
        "node", "f", "v", "rows", "positive",
        (F.col("n0") + F.sum("n").over(until)).alias("ln"),
        (F.col("p0") + F.sum("p").over(until)).alias("lp"),
        F.coalesce(F.lead("v").over(inside), F.col("beyond")).alias("following"),
    )
    score = _purity(F.col("lp"), F.col("ln")) + _purity(F.col("positive") - F.col("lp"), F.col("rows") - F.col("ln"))
    middle = (F.col("v") + F.col("following")) / 2
    # The middle of neighbouring doubles may round up to the greater one.
    threshold = F.when(middle < F.col("following"), middle).otherwise(F.col("v"))
    usable = (
        F.col("following").isNotNull()
        & (F.col("ln") >= min_rows)
        & (F.col("rows") - F.col("ln") >= min_rows)
        & (score - _purity(F.col("positive"), F.col("rows")) > LEAST_GAIN)
    )
    split = F.struct((-score).alias("order"), "f", threshold.alias("threshold"), "ln", "lp")
    # At most a row per open node: they are bounded by the depth.
    return placed.groupBy("node").agg(
        F.first("rows").alias("rows"), F.first("positive").alias("positive"), F.min(F.when(usable, split)).alias("best")
    ).collect()


def fit_tree_exact(
    df: DataFrame,
    features: Sequence[str],
    label: Column,
    max_depth: int = 4,
    min_rows: int = 1,
    slices: int | None = None,
) -> TreeArrays:
    """The tree that greedy Gini splitting gives when every value may be a threshold.

    A threshold lies in the middle between neighbouring values of its node. Of splits
    with equal gain the first feature, then the smallest threshold counts. A leaf
    answers with its more frequent label, 0 if both are. Rows without a label are
    left out, null and NaN features count as 0.

    Each level is one pass for all its nodes: rows are counted by node, feature and
    value, values are ordered in slices, and sums of the slices before make the sums of a slice
    prefix sums of the whole order. The driver holds the tree.
    """
    training = materialize(
        df.select(label.cast("int").alias("label"), *[filled(f).alias(f"x{i}") for i, f in enumerate(features)]).where(
            F.col("label").isNotNull()
        ),
        "training",
    )
    width = slices or min(MOST_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / width for i in range(1, width)]
    bounds: list[list[float]] = [[] for _ in features]
    if shares and features:
        found = training.agg(*[F.percentile_approx(f"x{i}", shares, 4 * width).alias(f"q{i}") for i in range(len(features))]).first()
        bounds = [sorted(set(found[f"q{i}"] or [])) for i in range(len(features))]

    # Nodes are numbered like a heap: the children of i are 2 i + 1 and 2 i + 2.
    nodes: dict[int, dict] = {}
    open_nodes = [0]
    for depth in range(max_depth + 1):
        if not open_nodes:
            break
        if depth == 0:
            node = F.lit(0)
        else:
            reached = TreeArrays.from_nodes(
                [n if n["feature"] is not None else {**n, "prediction": n["node"]} for n in nodes.values()]
            ).prefixed("")
            node = _on(reached, features).decision()
            node = F.when(node.isin(*open_nodes), node)
        if depth == max_depth or not features:
            break
        found = {r["node"]: r for r in _best_splits(training, node, bounds, min_rows)}
        if depth == 0:
            nodes[0] = _leaf(0, found[0]["rows"], found[0]["positive"]) if found else _leaf(0, 0, 0)
        following = []
        for number in open_nodes:
            best = found[number]["best"] if number in found else None
            if best is None:
                continue
            row, left, right = found[number], 2 * number + 1, 2 * number + 2
            nodes[number] = {
                "node": number, "feature": features[best["f"]], "threshold": best["threshold"],
                "left": left, "right": right, "prediction": None,
            }
            sides = ((left, best["ln"], best["lp"]), (right, row["rows"] - best["ln"], row["positive"] - best["lp"]))
            for child, rows, positive in sides:
                nodes[child] = _leaf(child, rows, positive)
                if 0 < positive < rows:
                    following.append(child)
        open_nodes = following
    if not nodes:
        counted = training.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
        nodes[0] = _leaf(0, counted["n"], counted["p"])
    return TreeArrays.from_nodes(nodes.values())


def _leaf(number: int, rows: float, positive: float) -> dict:
    answer = int(2 * positive > rows)
    return {"node": number, "feature": None, "threshold": None, "left": None, "right": None, "prediction": answer}


def _on(tree: TreeArrays, features: Sequence[str]) -> TreeArrays:
    """The tree over the training columns."""
    names = tuple(f"x{list(features).index(n)}" for n in tree.features)
    return TreeArrays(names, tree.feature, tree.threshold, tree.left, tree.right, tree.prediction, tree.depth)
