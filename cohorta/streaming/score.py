"""Scoring applicants as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cohorta.functions.scalar import ERREUR


def read_arrivals(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Stream of Parquet files appearing under ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_stream(
    arrivals: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    rejects: str | None = None,
    usable: Column | None = None,
) -> StreamingQuery:
    """Score every arriving batch with a batch plan and write it out.

    ``score`` is the same function batch tables use, with rank table and group
    means learned beforehand.  A batch owns one folder of the sink and replaces
    it when it is retried, so each row comes out once.  The folder also carries
    the query's id, which stays with its checkpoint: a query with another
    checkpoint adds to the sink.  All files present are processed, then the
    query stops.

    With ``rejects`` the scored rows that are not ``usable`` (by default those whose
    status says that they could not be scored) go to that sink, in the same way.
    """
    fine = F.col("Prediction_Status") != F.lit(ERREUR) if usable is None else usable

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the batch does not say which query it belongs to")
        scored, place = score(batch), f"query_id={query}/batch_id={batch_id}"
        if rejects is None:
            scored.write.mode("overwrite").parquet(f"{sink}/{place}")
            return
        # Scored once: the second sink is filled from what the first one's writing kept.
        kept = scored.persist()
        try:
            good = F.coalesce(fine, F.lit(False))
            kept.where(good).write.mode("overwrite").parquet(f"{sink}/{place}")
            kept.where(~good).write.mode("overwrite").parquet(f"{rejects}/{place}")
        finally:
            kept.unpersist()

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_scored(spark: SparkSession, sink: str) -> DataFrame:
    """All rows scored so far."""
    return spark.read.parquet(sink).drop("query_id", "batch_id")
