"""Pages of a table in key order, from a stored order instead of a sort for each page."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohorta.sources.versions import VersionLog


def write_pages(df: DataFrame, order_by: Sequence[str | Column], root: str) -> int:
    """Sort ``df`` once and store it with a page directory; returns the version.

    Every partition of the sort becomes a folder; the directory says how many rows
    lie in each, an entry per partition. Ties keep an order of their own, the same for
    every page of the version. Writing again makes a new version; readers see one
    version or the other.
    """
    spark, folder = df.sparkSession, f"pages/{uuid.uuid4().hex}"
    ordered = df.orderBy(*order_by).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.spark_partition_id().alias("part"),
        # The position in the partition: the lower 33 bits.
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    ordered.write.partitionBy("part").parquet(f"{root}/{folder}")
    schema = StructType([ordered.schema["row"], ordered.schema["place"], ordered.schema["part"]])
    stored = spark.read.schema(schema).parquet(f"{root}/{folder}")
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    content = {"folder": folder, "parts": [[r["part"], r["rows"]] for r in sizes], "schema": schema.json()}
    return VersionLog(spark, root).update(lambda version, _: content)


def read_page(spark: SparkSession, root: str, skip: int = 0, limit: int = 100, version: int | None = None) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in the stored order, read from the folders that hold them.

    A page beyond the last row is empty. With a ``version`` all pages of a reader come from
    one order, whatever is written meanwhile.
    """
    log = VersionLog(spark, root)
    content = log.read(version) if version else log.latest()[1]
    if not content:
        raise FileNotFoundError(f"no pages in {root}")
    wanted, start = [], 0
    for part, rows in content["parts"]:
        low, high = max(skip - start, 0), min(skip + limit - start, rows)
        if low < high:
            wanted.append((part, low, high))
        start += rows
    inside = F.lit(False)
    for part, low, high in wanted:
        inside = inside | ((F.col("part") == part) & (F.col("place") >= low) & (F.col("place") < high))
    schema = StructType.fromJson(json.loads(content["schema"]))
    stored = spark.read.schema(schema).parquet(f"{root}/{content['folder']}")
    page = stored.where(F.col("part").isin([p for p, _, _ in wanted])).where(inside)
    return page.orderBy("part", "place").select("row.*")


def count_rows(spark: SparkSession, root: str) -> int:
    """Rows of the stored order, from the directory alone."""
    return sum(rows for _, rows in VersionLog(spark, root).latest()[1].get("parts", ()))
