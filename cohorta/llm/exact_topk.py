"""Exact inner-product search over buckets of vectors of like length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.vectors import QueryBlock, merge_hits, pack, products, stream_search
from cohorta.scratch import materialize

QUERY_ROWS = 4096
BUCKET_ROWS = 512
# Local cosine from which a bucket is pruned by a coordinate instead of by length.
COORDINATE_FROM = 0.6
# Bounds are widened by this share, so that rounding never prunes a hit.
SLACK = 1e-9


class NormBuckets(QueryBlock):
    """Candidates come in buckets by descending length.

    With the k-th best score so far, a bucket's greatest length gives the least cosine
    a hit in it must have. Above 1 the bucket is out. A high cosine bounds the unit
    candidate's coordinate where the query is largest; a low one bounds its length.
    What is left is verified by the product.
    """

    def offer(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        floors = np.array([b.floor for b in self.best])
        reach = self.norms * norms.max() * (1 + SLACK)
        live = np.flatnonzero(reach + SLACK >= floors)
        if not len(live):
            return
        local = np.full(len(live), -1.0)
        np.divide(floors[live], reach[live], out=local, where=(reach[live] > 0) & np.isfinite(floors[live]))
        focused = local >= COORDINATE_FROM
        self._by_length(live[~focused], floors, ids, vectors, norms)
        if focused.any():
            units = vectors / np.maximum(norms, 1e-300)[:, None]
            for row, cosine in zip(live[focused], np.minimum(local[focused], 1.0)):
                self._by_coordinate(int(row), float(cosine), ids, vectors, units)

    def _by_length(self, rows, floors, ids, vectors, norms) -> None:
        if not len(rows):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(floors[rows] > 0, floors[rows] / self.norms[rows] * (1 - SLACK), -np.inf)
        enough = np.searchsorted(-norms, -least, side="right")
        scores = products(self.vectors[rows], vectors[: enough.max()])
        for row, n, score in zip(rows.tolist(), enough.tolist(), scores):
            self.take(row, ids[:n], score[:n])

    def _by_coordinate(self, row: int, cosine: float, ids, vectors, units) -> None:
        query = self.vectors[row, : vectors.shape[1]]
        focus = int(np.abs(query).argmax())
        angle = np.arccos(np.clip(query[focus] / self.norms[row], -1.0, 1.0))
        wide = np.arccos(cosine)
        low, high = np.cos(min(np.pi, angle + wide)), np.cos(max(0.0, angle - wide))
        near = np.flatnonzero((units[:, focus] >= low - 1e-7) & (units[:, focus] <= high + 1e-7))
        if len(near):
            self.take(row, ids[near], products(query[None, :], vectors[near])[0])


def quantise(scale: float):
    return lambda flat: np.floor(scale * flat)


def exact_top_k(
    df: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of floor(scale * x).

    Queries are the rows whose id is divisible by ``query_every``; candidates are all
    rows with another id. Blocks of queries meet lanes of candidates, each streamed by
    descending length. Ties go to the smaller id; fewer candidates give fewer rows.
    Vectors that are null or hold a null or non-finite component, and rows without
    an id, take no part. Rows that share an id are candidates of their own, and as
    queries share their ``k`` rows: the best scores of any of them. Shorter vectors end
    in zeros. Scores are exact below 2**53. An empty table gives an empty one; other
    columns do not matter.
    """
    spark = df.sparkSession
    rows = materialize(pack(df, id_col, vector, quantise(scale)), "packed")
    queries = rows.where(F.col("vec_id") % query_every == 0)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    lanes = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))
    lane = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(lanes))
    asked = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(
        (block * lanes + F.col("lane")).alias("group"),
        F.lit(0).alias("is_candidate"), "vec_id", "norm", "vec",
    )
    offered = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        (F.col("block") * lanes + lane).alias("group"),
        F.lit(1).alias("is_candidate"), "vec_id", "norm", "vec",
    )
    met = (
        asked.union(offered)
        .repartition(blocks * lanes, "group")
        .sortWithinPartitions("group", "is_candidate", F.desc("norm"), "vec_id")
    )
    best = merge_hits(stream_search(met, k, NormBuckets, BUCKET_ROWS), k)
    return best.withColumn("score", F.col("score").cast("long"))
