"""Approximate nearest neighbours by a tree of k-means centres, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.common import append_columns
from cohorta.llm.vectors import Best, QueryBlock, merge_hits, pack, products, stream_search, unpack
from cohorta.scratch import materialize

QUERY_ROWS = 4096
LANE_ROWS = 20_000
CANDIDATES = 4096


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes (0: root), the children of each, and the leaf number of nodes without any."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centre on every level."""
        vectors = _fitted(vectors, self.centres.shape[1])
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            nearest = _nearest(vectors[rows], self.centres[self.children[node]])
            todo += [(c, rows[nearest == i]) for i, c in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def visit(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves by a queue of nodes, the greatest product with the centre first.

        With the ``sizes`` of the leaves it goes on until those found hold ``least`` rows.
        """
        near = self.centres @ _fitted(query[None, :], self.centres.shape[1])[0]
        queue, found, held = [(-near[0], 0)], [], 0
        while queue and (len(found) < most or (sizes is not None and held < least)):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-near[child], child))
            else:
                found.append(self.leaf[node])
                held += 0 if sizes is None else int(sizes[self.leaf[node]])
        return found


def _fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    if vectors.shape[1] < width:
        return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    return vectors[:, :width]


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def grow_tree(sample: np.ndarray, branches: int = 8, leaf_rows: int = 128, rounds: int = 8, seed: int = 42) -> Tree:
    """Split the sample by k-means until a node has at most ``leaf_rows`` rows or equal vectors only."""
    chance = np.random.default_rng(seed)
    centres, children, leaf, leaves = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [[]], [-1], 0
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        points = sample[rows]
        means = np.unique(points, axis=0) if len(rows) <= leaf_rows * branches else points
        if len(rows) > leaf_rows and len(means) > 1:
            means = means[chance.choice(len(means), min(branches, len(means)), replace=False)]
            for _ in range(rounds):
                nearest = _nearest(points, means)
                means = np.stack([points[nearest == i].mean(axis=0) for i in range(len(means)) if (nearest == i).any()])
            nearest = _nearest(points, means)
            parts = [(means[i], rows[nearest == i]) for i in range(len(means)) if (nearest == i).any()]
        else:
            parts = []
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for mean, part in parts:
            children[node].append(len(centres))
            todo.append((len(centres), part))
            centres.append(mean)
            children.append([])
            leaf.append(-1)
    return Tree(np.stack(centres), children, leaf, leaves)


def _true_neighbours(index: DataFrame, queries: list, k: int) -> list:
    """(query_id, leaf) of the k nearest rows of a bounded list of queries, over the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [q["vec_id"] for q in shared.value]
        vectors = unpack([bytes(q["vec"]) for q in shared.value])
        best, leaf_of = [Best(k) for _ in ids], {}
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                others, leaves = part.column(0).to_numpy(), part.column(2).to_numpy()
                scores = products(vectors, unpack(part.column(1).to_pylist()))
                for row, own in enumerate(ids):
                    keep = others != own
                    best[row].offer(others[keep], scores[row][keep])
                leaf_of.update(zip(others.tolist(), leaves.tolist()))
                held = {i for b in best for i in b.ids.tolist()}
                leaf_of = {i: n for i, n in leaf_of.items() if i in held}
        rows = [(q, i, s, leaf_of[i]) for q, b in zip(ids, best) for i, s in zip(b.ids.tolist(), b.scores.tolist())]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        columns = [pa.array([r[c] for r in rows], kinds[c]) for c in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "leaf"])

    hits = index.select("vec_id", "vec", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # k rows for each of a bounded number of queries.
    return top.select("query_id", "leaf").collect()


def calibrate(tree: Tree, queries: list, truth: list, recall: float) -> int:
    """The least number of leaves that, visited best first, hold this share of the true neighbours."""
    order = {q["vec_id"]: tree.visit(np.frombuffer(bytes(q["vec"]), "<f8"), tree.leaves) for q in queries}
    place = {q: {leaf: n for n, leaf in enumerate(leaves, 1)} for q, leaves in order.items()}
    needed = sorted(place[t["query_id"]][t["leaf"]] for t in truth)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def _drawn(rows: DataFrame, total: int, most: int) -> DataFrame:
    """At most ``most`` rows, by a hash of the id: few partitions' rows reach the driver beyond them."""
    share = int(min(1.0, 1.25 * most / max(total, 1)) * (1 << 32))
    return rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 32)) < share).limit(most)


def nearest_neighbours(
    df: DataFrame,
    k: int = 20,
    query_every: int = 20,
    recall: float = 0.97,
    sample_rows: int = 20_000,
    calibration_queries: int = 256,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product.

    The tree is grown on at most ``sample_rows`` vectors (drawn by a hash of their
    ids) and indexes all rows. How many leaves a query visits is measured: up to
    ``calibration_queries`` queries are compared with all rows, and the least number of
    leaves that gives the wanted ``recall`` is used for all; a query goes on beyond it
    until its leaves hold more rows than share an id and ``k``, so it has ``k`` neighbours
    wherever there are as many candidates. Queries are rows whose id is
    divisible by ``query_every``; candidates are rows with another id; ties go to the
    smaller id. Null, zero and unusable vectors and rows without an id take no part.
    Rows that share an id are candidates of their own, and as queries share
    their ``k`` rows: the nearest to any of them. Scores are inner
    products of the vectors in double precision; a group of equal vectors is spread over
    lanes. An empty table gives an empty one; other columns do not matter.
    """
    rows = materialize(pack(df, id_col, vector).where("norm > 0"), "packed")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % query_every == 0, 1)).alias("queries")).first()
    sample = _drawn(rows, found["n"], sample_rows).select("vec").collect()
    tree = grow_tree(unpack([bytes(r["vec"]) for r in sample]))
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def assigning():
        return lambda vectors: [shared.value.assign(unpack(vectors))]

    index = materialize(append_columns(rows, "vec", "leaf long", assigning, CANDIDATES), "index")
    queries = index.where(F.col("vec_id") % query_every == 0).drop("leaf")
    tried = _drawn(queries, found["queries"], calibration_queries).select("vec_id", "vec").collect()
    visits = calibrate(tree, tried, _true_neighbours(index, tried, k), recall)

    # One row per leaf of the tree, whose size is bounded by the sample.
    lanes = materialize(
        index.groupBy("leaf").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(LANE_ROWS)).cast("long").alias("lanes"), F.count(F.lit(1)).alias("n")
        ),
        "lanes",
    )
    sizes, widest = np.zeros(tree.leaves, np.int64), 1
    for leaf in lanes.collect():
        sizes[leaf["leaf"]], widest = leaf["n"], max(widest, leaf["lanes"])
    lanes = lanes.drop("n")
    # The most rows of one id: as many of a query's own may lie in its leaves.
    same = queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1

    def visiting():
        return lambda vectors: [[shared.value.visit(np.frombuffer(v, "<f8"), visits, sizes, k + same) for v in vectors]]

    blocks = max(1, -(-found["queries"] // QUERY_ROWS))
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))

    def group(block_col, lane_col):
        return ((F.col("leaf") * blocks + block_col) * widest + lane_col).alias("group")

    asked = (
        append_columns(queries, "vec", "leaves array<long>", visiting, CANDIDATES)
        .withColumn("leaf", F.explode("leaves"))
        .join(F.broadcast(lanes), "leaf")
        .withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)))
        .select(group(block, F.col("lane")), F.lit(0).alias("is_candidate"), "vec_id", "norm", "vec")
    )
    offered = (
        index.join(F.broadcast(lanes), "leaf")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("lane", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("lanes")))
        .select(group(F.col("block"), F.col("lane")), F.lit(1).alias("is_candidate"), "vec_id", "norm", "vec")
    )
    met = asked.union(offered).repartition("group").sortWithinPartitions("group", "is_candidate", "vec_id")
    return merge_hits(stream_search(met, k, QueryBlock, CANDIDATES), k)
