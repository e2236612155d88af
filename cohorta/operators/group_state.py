"""Sums of groups as a state that is learned in one pass, merged, and turned into means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.functions.scalar import as_column


def group_state(df: DataFrame, groupings: Mapping[str, Sequence[str]], value: str) -> DataFrame:
    """(grouping, key columns, total, n) of every group of every grouping, in one pass.

    ``groupings`` gives the keys of each grouping by its name. A key column that a grouping
    does not have is null in its rows; rows whose own key or value is null are left
    out. Sums meet map-side, so a row costs one entry per grouping at most.
    """
    keys = _keys(groupings)
    rows = df.where(as_column(value).isNotNull()).select(*[as_column(k).alias(k) for k in keys], as_column(value).alias("__value"))
    summed = rows.groupingSets([list(g) for g in groupings.values()], *keys).agg(
        F.sum("__value").cast("double").alias("total"),
        F.count(F.lit(1)).alias("n"),
        *[F.grouping(k).alias(f"__absent_{i}") for i, k in enumerate(keys)],
    )
    name = F.lit(None).cast("string")
    for grouping, own in groupings.items():
        is_own = reduce(
            and_,
            [
                (F.col(f"__absent_{i}") == 0) & as_column(k).isNotNull() if k in own else F.col(f"__absent_{i}") == 1
                for i, k in enumerate(keys)
            ],
        )
        name = F.when(is_own, grouping).otherwise(name)
    named = summed.withColumn("grouping", name).where(F.col("grouping").isNotNull())
    return named.select("grouping", *[as_column(k) for k in keys], "total", "n")


def merge_states(*states: DataFrame) -> DataFrame:
    """One state for the rows of all: what was learned before, and new cohorts."""
    keys = [c for c in states[0].columns if c not in ("grouping", "total", "n")]
    together = reduce(lambda a, b: a.unionByName(b), states)
    return together.groupBy("grouping", *[as_column(k) for k in keys]).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def state_means(state: DataFrame, grouping: str, keys: Sequence[str], out: str) -> DataFrame:
    """(keys, out): the mean of each group of one grouping."""
    own = state.where(F.col("grouping") == grouping)
    return own.select(*[as_column(k) for k in keys], (F.col("total") / F.col("n")).alias(out))


def _keys(groupings: Mapping[str, Sequence[str]]) -> list[str]:
    repeated = {tuple(sorted(g)) for g in groupings.values()}
    if len(repeated) < len(groupings) or not groupings:
        raise ValueError("groupings must differ in their keys")
    return list(dict.fromkeys(k for own in groupings.values() for k in own))
