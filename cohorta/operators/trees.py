"""Decision trees of any size: as arrays walked by a fold, or as a table walked by joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.scalar import as_column
from cohorta.scratch import materialize

LEAF = -1


@dataclass(frozen=True)
class TreeArrays:
    """A tree as one array per property, indexed by node; node 0 is the root.

    ``feature`` is a place in ``features``, or LEAF. As a column a tree is five constant
    arrays and one fold over its depth, however many nodes it has.
    """

    features: tuple[str, ...]
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    prediction: tuple[int, ...]
    depth: int

    @classmethod
    def from_nodes(cls, nodes: Iterable[Mapping]) -> TreeArrays:
        """From rows (node, feature, threshold, left, right, prediction), root 0, in any order and numbering."""
        by_number = {row["node"]: row for row in nodes}
        if 0 not in by_number:
            raise ValueError("a tree needs a root, node 0")
        order, place, depth, level = [], {}, 0, [0]
        while level:
            below = []
            for number in level:
                if number not in by_number or number in place:
                    raise ValueError(f"not a tree: node {number} is missing or met twice")
                place[number] = len(order)
                row = by_number[number]
                order.append(row)
                if row["feature"] is not None:
                    below += [row["left"], row["right"]]
            depth += bool(below)
            level = below
        names = sorted({r["feature"] for r in order if r["feature"] is not None})
        number_of = {name: i for i, name in enumerate(names)}
        inner = [r["feature"] is not None for r in order]

        def taken(pick, other):
            return tuple(pick(r) if i else other for r, i in zip(order, inner))

        return cls(
            tuple(names),
            taken(lambda r: number_of[r["feature"]], LEAF),
            taken(lambda r: float(r["threshold"]), 0.0),
            taken(lambda r: place[r["left"]], LEAF),
            taken(lambda r: place[r["right"]], LEAF),
            tuple(LEAF if i else int(r["prediction"]) for r, i in zip(order, inner)),
            depth,
        )

    def rows(self) -> list[dict]:
        """The nodes again, as rows of a tree table without its key."""
        return [
            {"node": i, "feature": None, "threshold": None, "left": None, "right": None, "prediction": p} if f == LEAF
            else {"node": i, "feature": self.features[f], "threshold": t, "left": a, "right": b, "prediction": None}
            for i, (f, t, a, b, p) in enumerate(zip(self.feature, self.threshold, self.left, self.right, self.prediction))
        ]

    def prefixed(self, prefix: str) -> TreeArrays:
        names = tuple(prefix + n for n in self.features)
        return TreeArrays(names, self.feature, self.threshold, self.left, self.right, self.prediction, self.depth)

    def decision(self) -> Column:
        """The answer; null if a value on the way is null or NaN."""
        if not self.depth:
            return F.lit(self.prediction[0])
        # A leaf leads to itself: it asks the constant behind the values, whatever these are.
        asked = [len(self.features) if f == LEAF else f for f in self.feature]
        below = [n for i, pair in enumerate(zip(self.left, self.right)) for n in (pair if self.feature[i] != LEAF else (i, i))]
        feature, below, prediction = (constant_array(v, "int") for v in (asked, below, self.prediction))
        threshold = constant_array(self.threshold, "double")
        numbers = [as_column(n).cast("double") for n in self.features]
        values = F.array(*[F.when(~F.isnan(v), v) for v in numbers], F.lit(0.0))

        def step(at: Column, _) -> Column:
            node = at["node"]
            right = F.get(at["values"], F.get(feature, node)) > F.get(threshold, node)
            return F.struct(F.get(below, node * 2 + right.cast("int")).alias("node"), at["values"].alias("values"))

        # The values travel with the node, so that they are gathered once a row.
        start = F.struct(F.lit(0).alias("node"), values.alias("values"))
        levels = F.sequence(F.lit(1), F.lit(self.depth))
        return F.aggregate(levels, start, step, lambda end: F.get(prediction, end["node"]))


def constant_array(values: Sequence, kind: str) -> Column:
    """A constant array. Parsed from one text, which is folded when the plan is made, it costs one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def score_tree_table(
    df: DataFrame,
    trees: DataFrame,
    model_key: str,
    features: Sequence[str],
    out: str,
    max_depth: int = 64,
    key: str | None = None,
) -> DataFrame:
    """Append the answer of the tree ``model_key`` of a table, without its nodes ever meeting in the driver.

    Every level is one join of the rows with the nodes they stand at; only rows that
    have not reached a leaf go on. ``key`` names a column with a tree's key per row
    instead, for a forest of trees. A value on the way that is null or NaN, and a key
    without a tree, give null. Use it for trees too large for the plan; for others
    the arrays are one projection.
    """
    nodes = materialize(
        (trees if key else trees.where(F.col("model_key") == model_key)).select(
            F.col("model_key").alias("__key"), F.col("node").alias("__node"),
            F.struct("feature", "threshold", "left", "right", "prediction").alias("__at"),
        ),
        "tree-nodes",
    )
    wanted = F.col(key) if key else F.lit(model_key)
    values = F.create_map(*[c for f in features for c in (F.lit(f), as_column(f).cast("double"))])
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
        wanted.alias("__key"), F.lit(0).alias("__node"), values.alias("__values"),
    )
    done, level = None, rows
    for _ in range(max_depth + 1):
        met = materialize(level.join(nodes, ["__key", "__node"], "left"), "tree-level")
        at = F.col("__at")
        value, limit = F.element_at("__values", at["feature"]), at["threshold"]
        following = F.when(value <= limit, at["left"]).when((value > limit) & ~F.isnan(value), at["right"])
        met = met.withColumn("__next", following)
        ended = met.where(F.col("__next").isNull()).select(
            "__row", F.when(at["feature"].isNull(), at["prediction"]).alias("__answer")
        )
        done = ended if done is None else done.unionByName(ended)
        level = met.where(F.col("__next").isNotNull()).select(
            "__row", "__key", F.col("__next").alias("__node"), "__values"
        )
        if level.isEmpty():
            kept = [c for c in df.columns if c != out]
            return done.select(*[F.col("__row")[c].alias(c) for c in kept], F.col("__answer").alias(out))
    raise ValueError(f"a tree is deeper than {max_depth} levels, or its nodes form a circle")
