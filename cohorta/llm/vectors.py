"""Vectors as packed bytes, and streamed search of query groups against candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT_FIELDS = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & plain, F.lit(False))


def pack(df: DataFrame, id_col: str, vector: str, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(vec_id, norm, vec): usable vectors as little-endian doubles, after ``change``; null ids are left out."""
    narrow = df.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            flat, ends = rows.flatten().to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            flat = change(flat) if change else flat
            ends = ends - ends[0]
            parts = [flat[a:b] for a, b in zip(ends, ends[1:])]
            norms = [float(np.sqrt(p @ p)) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norms, pa.float64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["vec_id", "norm", "vec"],
            )

    return narrow.mapInArrow(run, "vec_id long, norm double, vec binary")


def unpack(vectors: list[bytes]) -> np.ndarray:
    """A matrix of packed vectors; shorter ones end in zeros."""
    width = max(map(len, vectors), default=0)
    if any(len(v) != width for v in vectors):
        vectors = [v.ljust(width, b"\0") for v in vectors]
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), width // 8)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width] @ b[:, :width].T


class Best:
    """The k best candidates of one query so far: highest score, ties to the smaller id."""

    __slots__ = ("ids", "scores", "k")

    def __init__(self, k: int):
        self.ids, self.scores, self.k = np.empty(0, np.int64), np.empty(0), k

    @property
    def floor(self) -> float:
        """The score a candidate must reach."""
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor
        if len(scores) > 4 * self.k and good.sum() > 4 * self.k:
            good &= scores >= np.partition(scores, -self.k)[-self.k]
        if not good.any():
            return
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


class QueryBlock:
    """Queries of one group, with their best candidates; ``offer`` meets a batch of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int):
        self.ids, self.vectors, self.norms = ids, vectors, norms
        self.best = [Best(k) for _ in ids]

    def take(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[row]
        self.best[row].offer(ids[other], scores[other])

    def offer(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        scores = products(self.vectors, vectors)
        for row in range(len(self.ids)):
            self.take(row, ids, scores[row])

    def hits(self) -> pa.RecordBatch:
        sizes = [len(b.ids) for b in self.best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, sizes)),
                pa.array(np.concatenate([np.empty(0, np.int64), *[b.ids for b in self.best]])),
                pa.array(np.concatenate([np.empty(0), *[b.scores for b in self.best]])),
            ],
            names=["query_id", "vec_id", "score"],
        )


def stream_search(grouped: DataFrame, k: int, block: type[QueryBlock], step: int) -> DataFrame:
    """Best candidates per (group, query) of rows (group, is_candidate, vec_id, norm, vec).

    Rows must be partitioned by ``group`` and sorted by group, queries first. A task
    holds the queries of one group and ``step`` candidates at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, queries = None, [], None

        def opened() -> QueryBlock | None:
            ids = np.array([w[0] for w in waiting], np.int64)
            return block(ids, unpack([w[2] for w in waiting]), np.array([w[1] for w in waiting]), k) if waiting else None

        for batch in batches:
            groups, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if b <= a:
                    continue
                if groups[a] != group:
                    if queries is not None:
                        yield queries.hits()
                    group, waiting, queries = groups[a], [], None
                ids, norms = batch.column(2).to_numpy()[a:b], batch.column(3).to_numpy()[a:b]
                vectors = batch.column(4).slice(a, b - a).to_pylist()
                if kinds[a] == 0:
                    waiting.extend(zip(ids.tolist(), norms.tolist(), vectors))
                    continue
                if queries is None:
                    queries, waiting = opened(), []
                for at in range(0, b - a if queries is not None else 0, step):
                    part = slice(at, at + step)
                    queries.offer(ids[part], unpack(vectors[part]), norms[part])
        if queries is not None:
            yield queries.hits()

    fields = grouped.select("group", "is_candidate", "vec_id", "norm", "vec")
    return fields.mapInArrow(run, HIT_FIELDS)


def merge_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query id over all groups, with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
