"""Hard negatives by an inverted multi-index over two halves of the vector space."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.vectors import products, unpack, usable
from cohorta.scratch import materialize

# Rows of one lane, which a task holds in memory: between these, by the width of the shuffle.
LEAST_LANE, MOST_LANE = 2048, 65_536
# Codes of a half, by the number of rows, and at most; a cell is a pair of codes.
ROWS_PER_CELL, MOST_CODES = 256, 128
STEP = 4096
# Bounds are widened by this share, so that rounding never leaves out a row.
SLACK = 1e-9


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, the greatest distance of a row's half from its code, and the lanes of each cell.

    ``first_lane`` and ``pieces`` are matrices over (first code, second code): a cell lies in
    one lane, or, if it holds more rows than a lane may, in several. Empty cells have no piece.
    """

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] = ()
    first_lane: np.ndarray = field(default=None)
    pieces: np.ndarray = field(default=None)

    @property
    def half(self) -> int:
        return self.codes[0].shape[1]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves; the second may be of any width that its code shares or the row ends before."""
        wide = self.half + self.codes[1].shape[1]
        if vectors.shape[1] < wide:
            vectors = np.pad(vectors, ((0, 0), (0, wide - vectors.shape[1])))
        return vectors[:, : self.half], vectors[:, self.half : wide]

    def assign(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each half the nearest code and the distance from it."""
        found = []
        for part, codes in zip(self.halves(vectors), self.codes):
            near = ((codes**2).sum(axis=1) - 2 * part @ codes.T).argmin(axis=1)
            found += [near, np.sqrt(((part - codes[near]) ** 2).sum(axis=1))]
        return found

    def bounds(self, query: np.ndarray) -> list[np.ndarray]:
        """For each half and code, the greatest product any row's half can have with the query's."""
        out = []
        for part, codes, radii in zip(self.halves(query[None, :]), self.codes, self.radii):
            bound = codes @ part[0] + radii * np.sqrt(part[0] @ part[0])
            out.append(bound + SLACK * (1 + np.abs(bound)))
        return out

    def visit(self, query: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first code, second code, bound) of all cells, the greatest bound first.

        The multi-sequence walk: both halves' codes in descending order of their bound,
        and a heap of the cells whose neighbours before them were visited.
        """
        left, right = self.bounds(query)
        order = np.argsort(-left, kind="stable").tolist(), np.argsort(-right, kind="stable").tolist()
        left, right = left[order[0]].tolist(), right[order[1]].tolist()
        heap = [(-(left[0] + right[0]), 0, 0)]
        reached = [0] * len(left)
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield order[0][i], order[1][j], -bound
            reached[i] = j + 1
            if i + 1 < len(left) and reached[i + 1] == j:
                heapq.heappush(heap, (-(left[i + 1] + right[j]), i + 1, j))
            if j + 1 < len(right) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (-(left[i] + right[j + 1]), i, j + 1))

    def lanes(self, query: np.ndarray, floor: float, most: int | None = None) -> list[int]:
        """Lanes of the cells that can hold a score of ``floor``; with ``most``, of so many cells."""
        found: dict[int, None] = {}
        seen = 0
        for i, j, bound in self.visit(query):
            if bound < floor or (most is not None and seen >= most):
                break
            pieces = int(self.pieces[i, j])
            if pieces:
                seen += 1
                start = int(self.first_lane[i, j])
                found.update(dict.fromkeys(range(start, start + pieces)))
        return list(found)


def _means(points: np.ndarray, count: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """k-means centres of at most ``count`` parts."""
    own = np.unique(points, axis=0)
    if len(own) <= count:
        return own
    means = own[np.random.default_rng(seed).choice(len(own), count, replace=False)]
    for _ in range(rounds):
        near = ((means**2).sum(axis=1) - 2 * points @ means.T).argmin(axis=1)
        means = np.stack([points[near == i].mean(axis=0) if (near == i).any() else means[i] for i in range(len(means))])
    return means


def _packed(df: DataFrame, id_col: str, vector: str, label: Column, scale: float) -> DataFrame:
    """(row, vec_id, label, vec) of the rows that take part; ``vec`` holds floor(scale * x) as doubles."""
    narrow = df.where(usable(vector) & F.col(id_col).isNotNull() & label.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(3)
            flat, ends = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False)), rows.offsets.to_numpy()
            ends = ends - ends[0]
            packed = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["row", "vec_id", "label", "vec"])

    return narrow.mapInArrow(run, "row long, vec_id long, label long, vec binary")


def build_index(rows: DataFrame, total: int, sample_rows: int, width: int) -> tuple[MultiIndex, DataFrame]:
    """The index and ``rows`` with their ``lane``.

    Codes come from at most ``sample_rows`` rows, drawn by a hash; all rows are assigned,
    and radii and lanes follow from all. At most MOST_CODES ** 2 cells come to the driver.
    """
    spark = rows.sparkSession
    # Twice the wanted share of the hashes, so that the limit meets few rows more than it takes.
    reach = int(min(1.0, 2 * sample_rows / max(total, 1)) * (1 << 32))
    drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 32)) < reach).limit(sample_rows).select("vec")
    sample = unpack([bytes(r["vec"]) for r in drawn.collect()])
    half = (sample.shape[1] + 1) // 2
    count = int(np.clip(np.ceil(np.sqrt(total / ROWS_PER_CELL)), 4, MOST_CODES))
    index = MultiIndex((_means(sample[:, :half], count), _means(sample[:, half:], count)))
    shared = spark.sparkContext.broadcast(index)

    def assigning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                found = shared.value.assign(unpack(part.column(3).to_pylist()))
                arrays = [pa.array(f, pa.float64() if i % 2 else pa.int64()) for i, f in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, "c1", "r1", "c2", "r2"])

    fields = "row long, vec_id long, label long, vec binary, c1 long, r1 double, c2 long, r2 double"
    placed = materialize(rows.mapInArrow(assigning, fields), "cells")
    cells = placed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    shape = tuple(len(c) for c in index.codes)
    radii, first_lane, pieces = [np.zeros(n) for n in shape], np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    most = int(np.clip(-(-total // width), LEAST_LANE, MOST_LANE))
    lane, filled = 0, 0
    # Small neighbouring cells share a lane, large ones are cut.
    for cell in sorted(cells.collect(), key=lambda c: (c["c1"], c["c2"])):
        i, j, n = cell["c1"], cell["c2"], cell["n"]
        radii[0][i], radii[1][j] = max(radii[0][i], cell["r1"]), max(radii[1][j], cell["r2"])
        if filled and filled + n > most:
            lane, filled = lane + 1, 0
        first_lane[i, j], pieces[i, j] = lane, -(-n // most)
        lane, filled = (lane + int(pieces[i, j]), 0) if n > most else (lane, filled + n)
    # An entry of both tables per cell of the index, bounded like the cells.
    table = [(int(i), int(j), int(first_lane[i, j]), int(pieces[i, j])) for i, j in np.argwhere(pieces)]
    places = spark.createDataFrame(table, "c1 long, c2 long, first_lane long, pieces long")
    piece = F.pmod(F.xxhash64("row"), F.col("pieces"))
    spread = placed.join(F.broadcast(places), ["c1", "c2"]).select(
        "row", "vec_id", "label", "vec", "c1", "c2", (F.col("first_lane") + piece).alias("lane")
    )
    return MultiIndex(index.codes, tuple(radii), first_lane, pieces), spread


class Lane:
    """The rows of one lane by cell, searched cell by cell for one anchor at a time."""

    def __init__(self, index: MultiIndex, ids: list, labels: list, vectors: list, cells: list):
        self.index = index
        order = sorted(range(len(ids)), key=cells.__getitem__)
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, np.int64)[order]
        self.vectors = unpack([vectors[i] for i in order])
        self.cells: dict[tuple[int, int], slice] = {}
        start = 0
        for at in range(1, len(order) + 1):
            if at == len(order) or cells[order[at]] != cells[order[start]]:
                self.cells[cells[order[start]]] = slice(start, at)
                start = at

    def _cells(self, query: np.ndarray) -> Iterator[tuple[slice, float]]:
        # A lane of few cells need not walk over all of the index.
        if len(self.cells) <= 8:
            left, right = self.index.bounds(query)
            yield from sorted(((s, left[i] + right[j]) for (i, j), s in self.cells.items()), key=lambda c: -c[1])
            return
        for i, j, bound in self.index.visit(query):
            if (i, j) in self.cells:
                yield self.cells[i, j], bound

    def positives(self, own: int, label: int, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """(id, score) of the ``k`` best rows of the label, all that reach ``floor``."""
        best: list[tuple[int, int]] = []
        for cell, bound in self._cells(query):
            if bound < max(floor, best[-1][1] if len(best) == k else -np.inf):
                break
            near = self.labels[cell] == label
            near &= self.ids[cell] != own
            if near.any():
                scores = products(query[None, :], self.vectors[cell][near])[0].astype(np.int64)
                best += zip(self.ids[cell][near].tolist(), scores.tolist())
                best = sorted(best, key=lambda b: (-b[1], b[0]))[:k]
        return best

    def negatives(self, own: int, label: int, query: np.ndarray, k: int, windows: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """For each window (least, greatest score), (id, score) of the ``k`` best rows of other labels in it."""
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        for cell, bound in self._cells(query):
            # A window is certified when no row beyond this cell can still enter it.
            open_ = [w for w, (least, _) in enumerate(windows) if bound >= (best[w][-1][1] if len(best[w]) == k else least)]
            if not open_:
                break
            other = (self.labels[cell] != label) & (self.ids[cell] != own)
            if not other.any():
                continue
            ids, scores = self.ids[cell][other], products(query[None, :], self.vectors[cell][other])[0].astype(np.int64)
            for w in open_:
                least, most = windows[w]
                fit = (scores >= least) & (scores <= most)
                if fit.any():
                    best[w] += zip(ids[fit].tolist(), scores[fit].tolist())
                    best[w] = sorted(best[w], key=lambda b: (-b[1], b[0]))[:k]
        return best


def _search(shared: Broadcast, spread: DataFrame, asked: DataFrame, k: int, fields: str, answer) -> DataFrame:
    """Meet the anchors of each lane with its rows: rows first, then anchors one after the other.

    ``asked`` has (lane, row, vec_id, label, vec, windows). A task holds one lane at a time.
    """
    none = F.lit(None).cast("array<struct<least:long,most:long>>")
    columns = ["lane", "asks", "row", "vec_id", "label", "vec", "c1", "c2", "windows"]
    held = spread.select("lane", F.lit(0).alias("asks"), "row", "vec_id", "label", "vec", "c1", "c2", none.alias("windows"))
    asks = asked.select(
        "lane", F.lit(1).alias("asks"), "row", "vec_id", "label", "vec",
        F.lit(None).cast("long").alias("c1"), F.lit(None).cast("long").alias("c2"), "windows",
    )
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane_id, lane, waiting = None, None, ([], [], [], [])
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            arrays = [pa.array([o[c] for o in out], pa.int64()) for c in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            for here, is_ask, row, vec_id, label, vec, c1, c2, windows in zip(*values):
                if here != lane_id:
                    lane_id, lane, waiting = here, None, ([], [], [], [])
                if not is_ask:
                    for column, value in zip(waiting, (vec_id, label, vec, (c1, c2))):
                        column.append(value)
                    continue
                if lane is None:
                    lane, waiting = Lane(shared.value, *waiting), ([], [], [], [])
                out += answer(lane, row, vec_id, label, np.frombuffer(vec, "<f8"), windows)
            yield flushed()

    met = held.union(asks).repartition("lane").sortWithinPartitions("lane", "asks")
    return met.mapInArrow(run, fields)


def _route(shared: Broadcast, anchors: DataFrame, most: int | None = None) -> DataFrame:
    """One row per anchor and lane that can hold a score of its ``floor`` (column, null: any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            floors = batch.column(batch.schema.get_field_index("floor")).to_pylist()
            lanes = [
                shared.value.lanes(np.frombuffer(v, "<f8"), -np.inf if f is None else f, most)
                for v, f in zip(vectors, floors)
            ]
            arrays = [*batch.columns, pa.array(lanes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lanes"])

    fields = "row long, vec_id long, label long, vec binary, windows array<struct<least:long,most:long>>, floor double"
    found = anchors.select("row", "vec_id", "label", "vec", "windows", F.col("floor").cast("double").alias("floor"))
    return found.mapInArrow(run, fields + ", lanes array<long>").withColumn("lane", F.explode("lanes")).drop("lanes")


def _first(hits: DataFrame, by: list[str], score: str, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine_hard_negatives(
    df: DataFrame,
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    sample_rows: int = 20_000,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    Anchors are the rows whose id is divisible by ``anchor_every``; scores are inner
    products of floor(scale * x). An anchor's positives are its first ``positives`` rows of
    its label and another id; a positive's negatives are the first ``negatives`` rows of another label and id
    whose score lies between ``window`` percent of the positive's score, both ends included.
    Higher scores come first, ties by smaller id.

    Every row lies in a cell of two half-space codes. A cell's score is bounded by the sum
    of its halves' bounds, which include the codes' radii. Anchors go to the lanes of the
    few cells with the greatest bounds first; the positives found there set the floor
    under which no further lane need be asked. Within a lane cells are visited by falling
    bound until every window is certified. Nothing is approximate.

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part. Rows that share an id are rows of their own. Shorter vectors end in zeros.
    Scores are exact below 2**53. A negative positive score has an empty window. An
    empty table gives an empty one; other columns do not matter.
    """
    spark = df.sparkSession
    rows = materialize(_packed(df, id_col, vector, F.col(label) if isinstance(label, str) else label, scale), "rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    index, spread = build_index(rows, total, sample_rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(index)
    spread = materialize(spread, "lanes")
    none = F.lit(None).cast("array<struct<least:long,most:long>>")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).withColumns({"windows": none, "floor": F.lit(None).cast("double")})
    found = "row long, vec_id long, score long"

    def best(lane, row, vec_id, label, query, windows, floor=-np.inf):
        return [(row, i, s) for i, s in lane.positives(vec_id, label, query, positives, floor)]

    # What the nearest cells hold gives a floor, and the floor the lanes that must be asked.
    seeds = _search(shared, spread, _route(shared, anchors, most=4), positives, found, best)
    floors = (
        _first(seeds, ["row"], "score", "vec_id", positives)
        .groupBy("row")
        .agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("least"))
    )
    floored = anchors.drop("floor").join(floors, "row", "left").withColumnRenamed("least", "floor")
    hits = _search(shared, spread, _route(shared, floored), positives, found, best)
    chosen = materialize(_first(hits, ["row"], "score", "vec_id", positives), "positives")

    low, high = window
    # 100 * n >= low * p and 100 * n <= high * p, as whole bounds on n.
    p = F.col("score")
    least, most = -F.expr(f"((-{low} * score) - pmod(-{low} * score, 100)) div 100"), F.expr(
        f"({high} * score - pmod({high} * score, 100)) div 100"
    )
    windows = (
        chosen.groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("place"), least.alias("least"), most.alias("most")))).alias("w"),
            F.min(F.when(least <= most, least)).alias("floor"),
        )
        .where(F.col("floor").isNotNull())
        .select("row", "floor", F.transform("w", lambda w: F.struct(w["least"], w["most"])).alias("windows"))
    )
    asked = anchors.drop("windows", "floor").join(windows, "row")

    def mined(lane, row, vec_id, label, query, windows):
        pairs = [(w["least"], w["most"]) for w in windows]
        for place, best in enumerate(lane.negatives(vec_id, label, query, negatives, pairs), 1):
            yield from ((row, place, i, s) for i, s in best)

    hits = _search(shared, spread, _route(shared, asked), negatives, "row long, place long, negative_id long, negative_score long", mined)
    ranked = _first(hits.withColumnRenamed("place", "positive"), ["row", "positive"], "negative_score", "negative_id", negatives)
    named = chosen.select("row", F.col("place").cast("long").alias("positive"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"))
    own = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return (
        ranked.join(named, ["row", "positive"])
        .join(own, "row")
        .select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
        )
    )
