"""Cutting an ordered column into slices of bounded size.

A window over a whole cohort, or over no partition key at all, runs in one
task.  The operators here cut the order into slices first, so a task sees one
slice, and add the row counts of the slices before it as an offset.  Slice
bounds are literals in the plan: a re-run task always cuts the same way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.scratch import materialize

MAX_SLICES = 8192
# More slices than the shuffle is wide are cut when one would exceed this.
ROWS_PER_SLICE = 2_000_000
# Rows the bounds of such finer slices are drawn from.
SAMPLE_ROWS = 20_000_000


@dataclass(frozen=True)
class Slices:
    """Ascending cut points, plus the slices that hold one frequent value.

    Slice ``i`` covers ``[bounds[i-1], bounds[i])``.  ``heavy`` maps a
    single-value slice to the number of pieces its rows should be split into.
    """

    bounds: tuple[float, ...]
    heavy: dict[int, int]

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def assign(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the slice index; null and NaN get the extra index ``count``."""
        if not self.bounds:
            missing = F.col(column).isNull() | F.isnan(column)
            return df.withColumn(out, F.when(missing, F.lit(1)).otherwise(F.lit(0)))
        cut = Bucketizer(
            splits=[-math.inf, *self.bounds, math.inf],
            inputCol=column,
            outputCol=out,
            handleInvalid="keep",
        )
        # The transformer passes nulls through.
        index = F.coalesce(F.col(out).cast("int"), F.lit(self.count))
        return cut.transform(df).withColumn(out, index)

    def is_heavy(self, slice_column: str) -> Column:
        return F.col(slice_column).isin(*self.heavy) if self.heavy else F.lit(False)

    def pieces(self, slice_column: str) -> Column:
        """Pieces of the row's slice: 1 unless the slice holds a frequent value."""
        if not self.heavy:
            return F.lit(1)
        table = F.create_map(*[F.lit(x) for item in sorted(self.heavy.items()) for x in item])
        return F.coalesce(F.element_at(table, F.col(slice_column)), F.lit(1))


def _quantiles(df: DataFrame, column: str, count: int) -> tuple[int, list[float]]:
    """Number of values, and the points that cut them into ``count`` equal shares."""
    shares = [i / count for i in range(1, count)]
    points = F.percentile_approx(column, shares, 4 * count)
    rows, found = df.agg(F.count(column), points).first()
    return rows, [float(p) for p in found or []]


def value_slices(df: DataFrame, column: str, count: int | None = None) -> Slices:
    """Slices of about equal row count over a numeric column.

    Without a ``count`` there are as many as the shuffle has partitions, or more
    if the rows ask for it; the bounds of many slices come from a sample, which
    touches their balance and nothing else.

    A value that fills two or more quantile points is frequent: it gets a slice
    of its own, and as many pieces as the points it filled, plus one.  There
    are fewer such values than slices, whatever the data.
    """
    width = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(2, min(width, MAX_SLICES))
    rows, points = _quantiles(df, column, width)
    finer = min(-(-rows // ROWS_PER_SLICE), MAX_SLICES)
    if count is None and finer > width:
        sample = df.sample(min(1.0, SAMPLE_ROWS / rows), seed=1)
        points = _quantiles(sample, column, finer)[1]
    repeats = Counter(p for p in points if math.isfinite(p))
    frequent = {p: n for p, n in repeats.items() if n > 1}
    after = (math.nextafter(p, math.inf) for p in frequent)
    bounds = tuple(sorted(set(repeats) | {p for p in after if math.isfinite(p)}))
    heavy = {bounds.index(p) + 1: n + 1 for p, n in frequent.items()}
    return Slices(bounds, heavy)


def number_rows(df: DataFrame, order_by: Sequence[str | Column], out: str, start: int = 1) -> DataFrame:
    """Number the rows of the whole frame in a total order, without one big task.

    The rows are range-sorted and written with their place (partition, position
    in the partition); the partition sizes, one row per partition, then give
    the offset of each partition.
    """
    placed = materialize(
        df.orderBy(*order_by).withColumn("__place", F.monotonically_increasing_id()), "numbered"
    )
    # monotonically_increasing_id: partition in the upper bits, position in the lower 33.
    part = F.shiftright("__place", 33).alias("__part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    position = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__part", F.shiftright("__place", 33))
        # One row per partition of the sort, so the side is bounded by the shuffle width.
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__offset") + position + F.lit(start))
        .drop("__part", "__place", "__offset")
    )
