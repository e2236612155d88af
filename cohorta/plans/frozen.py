"""What scoring needs to know of other rows, prepared once and kept: ranks, codes and means."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohorta.functions.scalar import number, one_zero
from cohorta.operators.asof import SMALL_TABLE_ROWS, found_or_miss, size_and_miss, steps_met, table_points
from cohorta.operators.features import FeatureStats
from cohorta.operators.slicing import Slices, number_rows
from cohorta.scratch import materialize
from cohorta.sources.versions import VersionLog

# Runs of steps a probe's score is met by: few for tables that are broadcast, more for others.
FEW_BUCKETS, MANY_BUCKETS = 512, 8192


@dataclass(frozen=True)
class PreparedRanks:
    """A score to rank table as steps [point, next point), cut into runs at ``bounds``.

    Looking up needs no job of its own: what the plan must know (bounds, size) is kept.
    """

    steps: DataFrame
    bounds: tuple[float, ...]
    size: int
    miss: int | None = 0

    def lookup(self, probes: DataFrame, score: str, out: str) -> DataFrame:
        """Add the value of the greatest point at or below each probe's score.

        Nothing there, a NaN score, or a null table value gives ``miss``; a null score null.
        Probes stay where they are unless the table is large; works on streams, too.
        """
        asked = probes.withColumn("__probe", one_zero(number(probes, score)))
        asked = Slices(self.bounds, {}).assign(asked, "__probe", "__bucket")
        steps = F.broadcast(self.steps) if self.size <= SMALL_TABLE_ROWS else self.steps
        found = asked.join(steps, steps_met(), "left")
        return found.withColumn(out, found_or_miss(self.miss)).drop(
            "__probe", "__bucket", "__at", "__point", "__next", "__found"
        )


def prepare_ranks(
    table: DataFrame, score: str = "score", rank: str = "rank", miss: int | str | None = 0, buckets: int | None = None
) -> PreparedRanks:
    """Order a rank table of any size and cut it into runs; it is read once. ``miss`` as in ``asof_lookup``."""
    points = materialize(number_rows(table_points(table, score, rank), ["__point"], "__n", start=0), "points")
    size, miss = size_and_miss(points, miss)
    points = points if miss is None else points.na.fill(miss, ["__value"])
    run = -(-size // (buckets or (FEW_BUCKETS if size <= SMALL_TABLE_ROWS else MANY_BUCKETS))) or 1
    starts = points.where(F.col("__n") % run == 0).select("__point").collect()
    bounds = tuple(sorted(r["__point"] for r in starts if math.isfinite(r["__point"])))
    following = points.select((F.col("__n") - 1).alias("__n"), F.col("__point").alias("__next"))
    steps = points.join(following, "__n", "left").select("__point", "__next", F.col("__value").alias("__found"))
    steps = Slices(bounds, {}).assign(steps, "__point", "__at")
    return PreparedRanks(materialize(steps, "steps"), bounds, size, miss)


@dataclass(frozen=True)
class FrozenState:
    """One version of what was learned: read only, the same for batches and streams."""

    version: int
    ranks: PreparedRanks | None = None
    stats: Mapping[str, FeatureStats] = field(default_factory=dict)


def freeze(
    spark: SparkSession, root: str, ranks: PreparedRanks | None = None, stats: Mapping[str, FeatureStats] | None = None
) -> int:
    """Store ranks and statistics (by a name of the caller's choice) as a new version.

    A version is complete or absent, and never changes: a stream that loaded one goes on
    with it until it is started with another.
    """
    folder, content = f"states/{uuid.uuid4().hex}", {"stats": {}}

    def put(df: DataFrame, name: str) -> dict:
        df.write.parquet(f"{root}/{folder}/{name}")
        return {"path": f"{folder}/{name}", "schema": df.schema.json()}

    if ranks is not None:
        bounds = [b.hex() for b in ranks.bounds]
        content["ranks"] = {"steps": put(ranks.steps, "steps"), "bounds": bounds, "size": ranks.size, "miss": ranks.miss}
    for name, learned in (stats or {}).items():
        content["stats"][name] = {
            "codes": put(learned.codes, f"{name}-codes") if learned.codes is not None else None,
            "means": {out: put(df, f"{name}-mean-{out}") for out, df in learned.means.items()},
        }
    return VersionLog(spark, root).update(lambda version, _: content)


def thaw(spark: SparkSession, root: str, version: int | None = None) -> FrozenState:
    """A stored version, the last one unless another is named. Starts no job."""
    log = VersionLog(spark, root)
    number_, content = (version, log.read(version)) if version else log.latest()
    if not number_:
        raise FileNotFoundError(f"nothing frozen in {root}")

    def get(entry: dict) -> DataFrame:
        import json

        return spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{root}/{entry['path']}")

    ranks = content.get("ranks")
    return FrozenState(
        number_,
        ranks and PreparedRanks(get(ranks["steps"]), tuple(map(float.fromhex, ranks["bounds"])), ranks["size"], ranks["miss"]),
        {
            name: FeatureStats(s["codes"] and get(s["codes"]), {out: get(e) for out, e in s["means"].items()})
            for name, s in content["stats"].items()
        },
    )
