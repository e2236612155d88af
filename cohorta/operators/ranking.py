"""Descending ranks per group with every tie rule, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, LongType, TimestampNTZType, TimestampType

from cohorta.functions.scalar import as_column, one_zero
from cohorta.operators.slicing import Slices, number_rows, value_slices
from cohorta.scratch import materialize

TIE_METHODS = ("average", "first", "min", "max", "dense")

# Ordered types whose values a double may confuse: they are ranked as they are.
OWN_ORDER = (LongType, DecimalType, DateType, TimestampType, TimestampNTZType, BooleanType)

# Below this many rows a page is a plain top-k; deeper pages go by row number.
TOP_K_ROWS = 10_000


def add_ranks(
    df: DataFrame,
    score: str,
    row_id: str,
    by: Sequence[str] = (),
    methods: Sequence[str] = ("average",),
    prefix: str = "rank_",
    slices: int | None = None,
) -> DataFrame:
    """Rank ``score`` from the highest down inside each ``by`` group.

    Adds one ``<prefix><method>`` column per tie rule.  ``first`` breaks ties by
    ``row_id`` (a unique number).  A null or NaN score keeps a null rank and the
    row stays.  No task ever holds a whole group: a group is ranked slice by
    slice, and a score shared by very many rows is split further by ``row_id``.
    The input is read three times (slice bounds, slice sizes, rows), so write a
    costly one to a table first.

    Whole numbers of 64 bits, decimals, dates, times and booleans are compared in their
    own type, other scores as doubles (a text as the number it holds).
    """
    unknown = set(methods) - set(TIE_METHODS)
    if unknown:
        raise ValueError(f"unknown tie methods: {sorted(unknown)}")
    if isinstance(df.select(as_column(score)).schema[0].dataType, OWN_ORDER):
        return _rank_by_value(df, score, row_id, by, methods, prefix)
    rows = df.withColumn("__score", as_column(score).cast("double"))
    rows = rows.withColumn("__score", F.when(~F.isnan("__score"), one_zero(F.col("__score"))))
    group = [f"__by{i}" for i in range(len(by))]
    rows = rows.withColumns({g: as_column(c) for g, c in zip(group, by)}) if by else rows
    cuts = value_slices(rows, "__score", slices)
    rows = _add_piece(cuts.assign(rows, "__score", "__slice"), cuts, row_id, slices)

    starts = _cell_starts(rows, group, cuts, with_distinct="dense" in methods)

    cell = [*group, "__slice", "__piece"]
    in_order = Window.partitionBy(*cell).orderBy(F.desc("__score"), F.asc(row_id))
    by_score = Window.partitionBy(*cell).orderBy(F.desc("__score"))
    if "first" in methods:
        rows = rows.withColumn("__row", F.row_number().over(in_order))
    rows = rows.withColumn("__rank", F.rank().over(by_score))
    if {"average", "max"} & set(methods):
        peers = F.count(F.lit(1)).over(by_score.rangeBetween(Window.currentRow, Window.currentRow))
        rows = rows.withColumn("__peers", peers)
    if "dense" in methods:
        rows = rows.withColumn("__dense", F.dense_rank().over(by_score))

    # A null group is a group: its key has to meet its own kind.
    starts = starts.withColumnsRenamed({c: f"{c}_start" for c in cell})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_start")) for c in group]
    same += [F.col(c) == F.col(f"{c}_start") for c in ("__slice", "__piece")]
    rows = rows.join(starts, reduce(and_, same), "left")
    low = F.col("__slice_above") + F.col("__rank")
    ties = F.when(cuts.is_heavy("__slice"), F.col("__slice_rows")).otherwise(F.col("__peers"))
    ranks = {
        "average": lambda: low + (ties - 1) / F.lit(2.0),
        "first": lambda: F.col("__cell_above") + F.col("__row"),
        "min": lambda: low,
        "max": lambda: low + ties - 1,
        "dense": lambda: F.col("__dense_above") + F.col("__dense"),
    }
    ranked = F.col("__score").isNotNull()
    return rows.select(
        *[as_column(c) for c in df.columns],
        *[F.when(ranked, ranks[m]()).alias(prefix + m) for m in methods],
    )


def _add_piece(rows: DataFrame, cuts: Slices, row_id: str, slices: int | None) -> DataFrame:
    """Split the rows of each frequent score into ranges of its own ids.

    The bounds are quantiles of the ids that share the score, which may lie close
    together among all ids.  There are fewer bounds than twice the slices.  Rows
    without a score need no order, so a hash of the id spreads them.
    """
    spread = F.pmod(F.xxhash64(row_id), F.lit(cuts.count)).cast("int")
    if not cuts.heavy:
        return rows.withColumn("__piece", F.when(F.col("__score").isNull(), spread).otherwise(0))
    most = max(cuts.heavy.values())
    points = F.percentile_approx(row_id, [i / most for i in range(1, most)], 4 * max(most, slices or most))
    # Of the points of the finest cut, as many as the score has pieces.
    wanted = F.filter(
        "points", lambda _, i: F.floor((i + 1) * F.col("n") / F.lit(most)) > F.floor(i * F.col("n") / F.lit(most))
    )
    hot = rows.where(cuts.is_heavy("__slice")).groupBy("__slice", cuts.pieces("__slice").alias("n"))
    found = hot.agg(points.alias("points")).select("__slice", wanted.alias("points")).collect()
    table = F.create_map(*[x for r in found for x in (F.lit(r["__slice"]), F.array(*map(F.lit, r["points"])))])
    bounds = F.element_at(table, F.col("__slice"))
    piece = F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col(row_id))), F.lit(0))
    piece = F.when(cuts.is_heavy("__slice"), piece).otherwise(F.lit(0))
    return rows.withColumn("__piece", F.when(F.col("__score").isNull(), spread).otherwise(piece))


def _cell_starts(rows: DataFrame, group: list[str], cuts: Slices, with_distinct: bool) -> DataFrame:
    """Per (group, slice, piece): how many rows and scores rank above it.

    At most a few cells per slice and group, counted with map-side aggregation.
    """
    cell = [*group, "__slice", "__piece"]
    scored = rows.where(F.col("__score").isNotNull())
    if with_distinct:
        scored = scored.groupBy(*cell, "__score").agg(F.count(F.lit(1)).alias("__n"))
        sizes = scored.groupBy(*cell).agg(
            F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__distinct")
        )
    else:
        sizes = scored.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))

    down = Window.partitionBy(*group).orderBy(F.desc("__slice"), F.asc("__piece"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole_slice = Window.partitionBy(*group, "__slice")
    starts = sizes.withColumn("__cell_above", F.coalesce(F.sum("__n").over(above), F.lit(0)))
    if with_distinct:
        # The pieces of a frequent score share one distinct value: count it once.
        first_piece = F.row_number().over(whole_slice.orderBy("__piece")) == 1
        scores = F.when(cuts.is_heavy("__slice") & ~first_piece, 0).otherwise(F.col("__distinct"))
        starts = starts.withColumn("__scores", scores).withColumn(
            "__dense_above", F.coalesce(F.sum("__scores").over(above), F.lit(0))
        )
        starts = starts.withColumn("__dense_above", F.min("__dense_above").over(whole_slice))
    starts = starts.withColumn("__slice_above", F.min("__cell_above").over(whole_slice))
    starts = starts.withColumn("__slice_rows", F.sum("__n").over(whole_slice))
    return starts.drop("__n", "__distinct", "__scores")


def _rank_by_value(
    df: DataFrame, score: str, row_id: str, by: Sequence[str], methods: Sequence[str], prefix: str
) -> DataFrame:
    """Rank distinct values, which have no ties, and give every row the ranks of its value.

    Values are counted first, so a frequent one is one row, and range-partitioned in
    their own type, so the values above a range are those of the ranges before it.
    ``first`` also numbers the rows in that order; a row's distance to its value's first
    row orders it among its equals.
    """
    group = [f"__by{i}" for i in range(len(by))]
    own = [F.struct(*[as_column(c) for c in df.columns]).alias("__row"), as_column(score).alias("__score")]
    rows = df.select(*own, *[as_column(c).alias(g) for g, c in zip(group, by)], as_column(row_id).alias("__id"))
    if "first" in methods:
        rows = number_rows(rows, [*group, F.desc("__score"), "__id"], "__number")
    counts = [F.count(F.lit(1)).alias("__n")] + ([F.min("__number").alias("__start")] if "first" in methods else [])
    values = rows.where(F.col("__score").isNotNull()).groupBy(*group, "__score").agg(*counts)
    ranged = values.repartitionByRange(*group, F.desc("__score")).withColumn("__range", F.spark_partition_id())
    values = materialize(ranged, "values")

    # A row per group and range: their sums over the ranges before.
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = values.groupBy(*group, "__range").agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__values"))
    ranges = ranges.select(
        *[F.col(g).alias(f"{g}_range") for g in group],
        F.col("__range").alias("__at"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__above"),
        F.coalesce(F.sum("__values").over(before), F.lit(0)).alias("__dense_above"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"{g}_range")) for g in group]
    placed = values.join(ranges, reduce(and_, [*same, F.col("__range") == F.col("__at")]))
    inside = Window.partitionBy(*group, "__range").orderBy(F.desc("__score"))
    greater = F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select(
        *[F.col(g).alias(f"{g}_value") for g in group],
        F.col("__score").alias("__value"),
        "__n",
        *(["__start"] if "first" in methods else []),
        (F.col("__above") + greater + 1).alias("__low"),
        (F.col("__dense_above") + F.row_number().over(inside)).alias("__dense"),
    )
    # Written, so that a hot value meets its rows by broadcast or by a join that can be split.
    placed = materialize(placed, "value-ranks")
    same = [F.col(g).eqNullSafe(F.col(f"{g}_value")) for g in group]
    found = rows.join(placed, reduce(and_, [*same, F.col("__score") == F.col("__value")]), "left")
    low, ties = F.col("__low"), F.col("__n")
    ranks = {
        "average": lambda: low + (ties - 1) / F.lit(2.0),
        "first": lambda: low + F.col("__number") - F.col("__start"),
        "min": lambda: low,
        "max": lambda: low + ties - 1,
        "dense": lambda: F.col("__dense"),
    }
    return found.select("__row.*", *[ranks[m]().alias(prefix + m) for m in methods])


def rank_table(df: DataFrame, score: str, row_id: str, out_score: str = "score", out_rank: str = "rank") -> DataFrame:
    """Score to rank table over all rows: descending, equal scores share the lowest rank."""
    ranked = add_ranks(df.where(F.col(score).isNotNull()), score, row_id, methods=("min",))
    return ranked.select(F.col(score).alias(out_score), F.col("rank_min").alias(out_rank))


def sort_by_score(df: DataFrame, score: str, row_id: str, index: str | None = None) -> DataFrame:
    """Sort by descending score, ties by ``row_id``; optionally add a fresh 0-based index."""
    order = [F.desc_nulls_last(score), F.asc(row_id)]
    if index is None:
        return df.orderBy(*order)
    return number_rows(df, order, index, start=0).orderBy(index)


def paginate(df: DataFrame, key: str | Column, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in ``key`` order."""
    if skip + limit <= TOP_K_ROWS:
        return df.orderBy(key).offset(skip).limit(limit)
    numbered = number_rows(df, [key], "__row", start=0)
    page = (F.col("__row") >= skip) & (F.col("__row") < skip + limit)
    return numbered.where(page).orderBy("__row").drop("__row")


def null_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which any of the given score columns is null."""
    missing = F.lit(False)
    for name in columns:
        missing = missing | F.col(name).isNull()
    return df.where(missing)
