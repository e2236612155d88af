"""As-of lookup: the greatest table score at or below a score gives its value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.scalar import as_column, number, one_zero
from cohorta.operators.slicing import Slices, value_slices
from cohorta.scratch import materialize

# Up to this many distinct scores the table travels to the executors.
SMALL_TABLE_ROWS = 100_000
# Buckets the steps of such a table are met by.
BUCKETS = 512


def asof_lookup(
    probes: DataFrame,
    table: DataFrame,
    probe_score: str,
    table_score: str,
    table_value: str,
    out: str,
    row_id: str,
    miss: int | str | None = 0,
    small_rows: int = SMALL_TABLE_ROWS,
    slices: int | None = None,
) -> DataFrame:
    """Add to each probe the value of the greatest table score <= its own score.

    Nothing at or below, a NaN score, or a null table value gives ``miss``, which
    may be ``"last"``: the greatest value of the table.  A null score gives null.  Text scores are trimmed and parsed first.  Tables
    up to ``small_rows`` distinct scores are looked up without moving the
    probes; larger ones are sliced along with the probes.
    """
    points = table_points(table, table_score, table_value)
    probes = probes.withColumn("__probe", one_zero(number(probes, probe_score)))
    # Written once: its size decides the way, and either way reads it again.
    points = materialize(points, "points")
    size, miss = size_and_miss(points, miss)
    points = points if miss is None else points.na.fill(miss, ["__value"])
    if size <= small_rows:
        found = _by_broadcast(probes, points, size)
    else:
        found = _by_slices(probes, points, row_id, slices)
    return found.withColumn(out, found_or_miss(miss)).drop("__probe", "__found")


def size_and_miss(points: DataFrame, miss: int | str | None) -> tuple[int, int | None]:
    """How many points there are, and the value of a miss; ``last`` is null where no point has a value."""
    if isinstance(miss, str) and miss != "last":
        raise ValueError(f"a miss is a number, None or 'last', not {miss!r}")
    found = points.agg(F.count(F.lit(1)).alias("n"), F.max("__value").alias("last")).first()
    return found["n"], found["last"] if miss == "last" else miss


def table_points(table: DataFrame, score: str, value: str) -> DataFrame:
    """(__point, __value): the distinct scores of the table, each with its least value."""
    return (
        table.select(
            one_zero(number(table, score)).alias("__point"),
            F.nanvl(number(table, value), F.lit(None).cast("double")).cast("long").alias("__value"),
        )
        .where(F.col("__point").isNotNull() & ~F.isnan("__point"))
        .groupBy("__point")
        .agg(F.min("__value").alias("__value"))
    )


def steps_met() -> Column:
    """Where a probe lies on a step of its run."""
    return (
        (F.col("__bucket") == F.col("__at"))
        & (F.col("__point") <= F.col("__probe"))
        & (F.col("__next").isNull() | (F.col("__probe") < F.col("__next")))
    )


def found_or_miss(miss: int | None) -> Column:
    none = F.lit(None if miss is None else miss).cast("long")
    return (
        F.when(F.col("__probe").isNull(), F.lit(None).cast("long"))
        .when(F.isnan("__probe"), none)
        .otherwise(F.coalesce(F.col("__found"), none))
    )


def _by_broadcast(probes: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """Join each probe to the step [score, next score) it lies on.

    The steps travel by broadcast and are met by bucket, a run of consecutive
    steps, so a probe is compared with the few steps of one bucket only.
    """
    # One task orders the steps: at most small_rows rows, checked by the caller.
    order = Window.orderBy("__point")
    steps = points.select(
        "__point",
        F.lead("__point").over(order).alias("__next"),
        F.col("__value").alias("__found"),
        (F.row_number().over(order) - 1).alias("__n"),
    )
    run = -(-size // BUCKETS) or 1
    starts = steps.where(F.col("__n") % run == 0).select("__point").collect()
    bounds = sorted(r["__point"] for r in starts if math.isfinite(r["__point"]))
    buckets = Slices(tuple(bounds), {})
    asked = buckets.assign(probes, "__probe", "__bucket")
    steps = buckets.assign(steps.drop("__n"), "__point", "__at")
    found = asked.join(F.broadcast(steps), steps_met(), "left")
    return found.drop("__bucket", "__at", "__point", "__next")


def _by_slices(probes: DataFrame, points: DataFrame, row_id: str, slices: int | None) -> DataFrame:
    """Carry the last table value forward inside slices, and across them by offset.

    A slice is bounded in rows; a score shared by very many probes has its own
    slice, spread over pieces that each receive the (one) table row of it.
    """
    scores = probes.select("__probe").unionByName(points.select(F.col("__point").alias("__probe")))
    cuts = value_slices(scores, "__probe", slices)

    asked = cuts.assign(probes, "__probe", "__slice")
    no_score = F.col("__slice") == cuts.count
    pieces = F.when(no_score, F.lit(cuts.count)).otherwise(cuts.pieces("__slice"))
    asked = asked.withColumn("__piece", F.pmod(F.xxhash64(row_id), pieces).cast("int"))

    known = cuts.assign(points, "__point", "__slice")
    copies = known.withColumn(
        "__piece", F.explode(F.sequence(F.lit(0), cuts.pieces("__slice").cast("int") - 1))
    )

    # A value travels inside a struct, so that a null value still counts as found.
    held = F.struct("__value")
    # Per slice the value of its highest score, carried over the slices above it.
    last = known.groupBy("__slice").agg(F.max_by(held, "__point").alias("__last"))
    every = probes.sparkSession.range(cuts.count).select(F.col("id").cast("int").alias("__slice"))
    below = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(last, "__slice", "left").select(
        "__slice", F.last("__last", ignorenulls=True).over(below).alias("__carried")
    )

    columns = [as_column(c) for c in probes.columns]
    both = asked.select(
        "__slice", "__piece", F.col("__probe").alias("__at"), F.lit(1).alias("__is_probe"),
        F.struct(*columns).alias("__row"),
    ).unionByName(
        copies.select(
            "__slice", "__piece", F.col("__point").alias("__at"), F.lit(0).alias("__is_probe"),
            held.alias("__held"),
        ),
        allowMissingColumns=True,
    )
    so_far = (
        Window.partitionBy("__slice", "__piece")
        .orderBy("__at", "__is_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("__inside", F.last("__held", ignorenulls=True).over(so_far))
        .where(F.col("__is_probe") == 1)
        # One row per slice; MAX_SLICES bounds them.
        .join(F.broadcast(carried), "__slice", "left")
        .select("__row.*", F.coalesce("__inside", "__carried")["__value"].alias("__found"))
    )
