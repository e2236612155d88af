"""Near-duplicates by 64-bit SimHash fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.common import append_columns, unused_name
from cohorta.scratch import materialize

SEED = 42
BITS, BYTES = 64, 8
# Postings of up to this many fingerprints are compared; larger ones are split further.
POSTING_ROWS = 512
# Fingerprints compared at once in a task.
BUFFER_ROWS = 1 << 14
# Shingles hashed at once.
WINDOW = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of each bit over the hashes of all shingles, repeats included; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), WINDOW):
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + WINDOW], ends[at : at + WINDOW])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * votes > len(starts)).tolist())


def signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """Append ``fingerprint_bits`` (a long with the 64 bits) to every row."""

    def make():
        return lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]]

    return append_columns(df, text, "fingerprint_bits long", make)


def _byte_mask(places) -> int:
    return sum(0xFF << (8 * p) for p in places)


def first_masks() -> list[int]:
    """Triples of byte places such that any five of the eight places hold one: three lie in one half."""
    return [_byte_mask(t) for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def finer_masks(mask: int) -> list[int]:
    """Longer keys that together keep every pair with five equal bytes and at most three different bits.

    Below five places, one more place is added: of the r open places m must still
    match, so any r - m + 1 of them hold a matching one. From five on, the open bits
    fall into four blocks, of which three different bits leave one untouched.
    """
    places = [p for p in range(BYTES) if mask >> (8 * p) & 0xFF]
    open_places = [p for p in range(BYTES) if p not in places]
    if len(places) < 5:
        enough = len(open_places) - (5 - len(places)) + 1
        return [mask | _byte_mask([p]) for p in open_places[:enough]]
    free = [k for k in range(BITS) if not mask >> k & 1]
    return [mask | sum(1 << k for k in free[b::4]) for b in range(4)]


def linked_pairs(keys: np.ndarray, bits: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked fingerprints within equal keys; rows are sorted by key.

    Shared bytes of each pair are tallied first; pairs with fewer than 8 - max_bits
    cannot be within max_bits, the others are verified on their bits.
    """
    left, right = [], []
    for step in range(1, len(bits)):
        first = np.flatnonzero((keys[:-step] == keys[step:]).all(axis=1))
        if not len(first):
            break
        differing = bits[first] ^ bits[first + step]
        shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        first, differing = first[shared >= BYTES - max_bits], differing[shared >= BYTES - max_bits]
        first = first[np.bitwise_count(differing) <= max_bits]
        left.append(first)
        right.append(first + step)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def least_members(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``size`` items the smallest index it is connected with."""
    label = np.arange(size)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            bits = rows[:, 2].copy().view(np.uint64)
            label = least_members(len(rows), *linked_pairs(rows[:, :2], bits, max_bits))
            joined = np.flatnonzero(label != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[joined, 2]), pa.array(rows[label[joined], 2])], names=["a", "b"]
            )

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            # Whole postings only: the last one may go on in the next batch.
            whole = 0
            if len(held) >= BUFFER_ROWS:
                whole = int(np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1)).max(initial=-1)) + 1
            if whole:
                yield links(held[:whole])
                held = held[whole:]
        if len(held):
            yield links(held)

    return run


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct ``bits`` in ``nodes`` that connect just what is within ``max_bits``.

    An index on byte places gives postings of fingerprints that agree in three
    places. Postings of more than POSTING_ROWS fingerprints are not compared but
    indexed again under longer keys, so no task meets a large one, whatever share
    of the fingerprints it holds. Within a posting all pairs are tallied and
    verified, and one link per fingerprint to the least of its connected ones is kept.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    spark = nodes.sparkSession
    postings = nodes.select("bits", F.explode(F.array(*[F.lit(signed(m)) for m in first_masks()])).alias("mask"))
    found = []
    while True:
        keyed = postings.select("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("key"), "bits")
        sizes = materialize(
            keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "posting-sizes"
        )
        # The stored side has one row per key, so adaptive execution may split a hot key.
        level = materialize(keyed.join(sizes, ["mask", "key"]).select("mask", "key", "bits", "size"), "postings")
        # A key with few open bits has a bounded posting and need not be split.
        open_bits = F.lit(BITS) - F.bit_count("mask")
        splits = (F.col("size") > POSTING_ROWS) & (open_bits > F.lit(POSTING_ROWS.bit_length() - 1))
        small = level.where(~splits).select("mask", "key", "bits")
        found.append(
            small.repartition("mask", "key")
            .sortWithinPartitions("mask", "key", "bits")
            .mapInArrow(_compare(max_bits), "a long, b long")
        )
        # Masks, not keys: how many there are depends on the level alone.
        split = [r["mask"] for r in level.where(splits).select("mask").distinct().collect()]
        if not split:
            break
        rows = [(m, signed(f)) for m in split for f in finer_masks(m % (1 << BITS))]
        table = spark.createDataFrame(rows, "mask long, finer long")
        postings = (
            level.where(splits)
            .join(F.broadcast(table), "mask")
            .select("bits", F.col("finer").alias("mask"))
            .distinct()
        )
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Connected components: (node, root) for each node but the roots, the least of their component.

    Rounds of linking larger neighbours, then smaller ones, to the least neighbour
    (the number of rounds grows with the logarithm of the longest chain). Every
    round is written to the shared folder.
    """
    edges = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(),
        "edges",
    )
    seen = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == seen or state["n"] == 0:
            return edges
        seen = state
        both = edges.union(edges.select("root", "node")).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialize(
            both.join(least, "u").where("v > u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct(),
            "large-star",
        )
        lowest = materialize(large.groupBy("node").agg(F.min("root").alias("m")), "lowest")
        small = large.join(lowest, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        edges = materialize(lowest.toDF("node", "root").union(small).distinct(), "edges")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """(id, fingerprint_bits, component_id, group_bits) for every row of ``df``.

    Fingerprints link at ``max_bits`` or fewer differing bits, and components are
    what links reach; ``component_id`` is the smallest id reachable. Texts without a
    word have fingerprint 0 and link like any other. Null ids take part, but never
    name a component; one without any other id has a null ``component_id``. The least
    fingerprint of a component, ``group_bits``, names it in any case. Repeated rows and
    repeated ids stay as they are. Other columns do not matter.
    """
    narrow = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    rows = materialize(fingerprints(narrow, "__text", shingle).drop("__text"), "fingerprints")
    nodes = materialize(
        rows.groupBy(F.col("fingerprint_bits").alias("bits")).agg(F.min("__id").alias("first")), "nodes"
    )
    roots = components(links(nodes, max_bits)).toDF("bits", "root")
    rooted = materialize(
        nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits")), "rooted"
    )
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = materialize(
        rooted.join(firsts, "root").select(F.col("bits").alias("fingerprint_bits"), "component_id", F.col("root").alias("group_bits")),
        "named",
    )
    return rows.join(named, "fingerprint_bits").select(
        F.col("__id").alias(id_col), "fingerprint_bits", "component_id", "group_bits"
    )


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """The row with the smallest id of each component, with all its columns.

    A component keeps one row, whatever other components hold rows of the same id; if
    that id repeats within it, the one with the least fingerprint. A component of null
    ids only keeps one of its rows.
    """
    groups = near_duplicates(df, id_col, text, shingle, max_bits)
    # One (id, fingerprint) per component; no two components share a fingerprint.
    chosen = materialize(
        groups.where(F.col(id_col).eqNullSafe(F.col("component_id")))
        .groupBy("group_bits")
        .agg(F.min("component_id").alias("__keep"), F.min("fingerprint_bits").alias("__keep_bits"))
        .drop("group_bits"),
        "kept",
    )

    bits = unused_name(df, "bits")

    def own(rows: DataFrame) -> DataFrame:
        return append_columns(
            rows, text, f"{bits} long", lambda: lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]]
        )

    # The chosen pairs are distinct and stored, and the rows of one pair are copies of one document.
    keep, keep_bits = unused_name(df, "keep"), unused_name(df, "keep_bits")
    chosen = chosen.select(F.col("__keep").alias(keep), F.col("__keep_bits").alias(keep_bits))
    rows = own(df)
    same = (rows[f"`{id_col}`"] == chosen[keep]) & (rows[bits] == chosen[keep_bits])
    named = rows.join(chosen, same, "left_semi").dropDuplicates([id_col, bits]).drop(bits)
    if df.where(F.col(f"`{id_col}`").isNull()).isEmpty():
        return named
    nameless = own(df.where(F.col(f"`{id_col}`").isNull()))
    lone = chosen.where(F.col(keep).isNull())
    rest = nameless.join(lone, nameless[bits] == lone[keep_bits], "left_semi").dropDuplicates([bits])
    return named.unionByName(rest.drop(bits))
