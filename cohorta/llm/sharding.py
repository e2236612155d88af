"""A reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.common import append_columns
from cohorta.operators.slicing import number_rows

ROUNDS = 6


class Permutation:
    """A permutation of 0 to n - 1 fixed by ``n`` and ``seed``, computable in both directions.

    A Feistel network permutes the smallest range of an even number of bits that
    holds n; a result outside 0 to n - 1 is permuted again until it falls inside.
    """

    def __init__(self, n: int, seed: int = 42):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        keys = np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(ROUNDS * (seed % (1 << 32)))
        self.keys = [self._mix(k) for k in keys]

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (self._mix(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (self._mix(right ^ key) & self.mask)
        return left << shift | right

    def _walk(self, values, back: bool) -> np.ndarray:
        out = self._once(np.asarray(values, np.uint64), back)
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def place(self, rows) -> np.ndarray:
        """Shuffled places of row numbers."""
        return self._walk(rows, back=False)

    def row(self, places) -> np.ndarray:
        """Row numbers at shuffled places."""
        return self._walk(places, back=True)


def locate(rows, n: int, shards: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers, without looking at any data."""
    place = Permutation(n, seed).place(rows)
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 42) -> int:
    """The row number at a shard's slot."""
    return int(Permutation(n, seed).row([slot * shards + shard])[0])


def shard_rows(df: DataFrame, order_by: list[str], shards: int, seed: int = 42) -> DataFrame:
    """Append ``row`` (number in the order of ``order_by``, from 0), ``shard`` and ``slot`` to every row.

    Shards differ by at most one row, and slots count from 0 without gaps. Rows that
    are equal in ``order_by`` (nulls first) may take each other's place. An empty table
    gives an empty one; input columns named like a result are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    taken = {"row", "shard", "slot"}
    numbered = number_rows(df.drop(*[c for c in df.columns if c.lower() in taken]), order_by, "row", start=0)
    n = numbered.count()

    def make():
        def compute(rows: list) -> list:
            shard, slot = locate(rows, n, shards, seed)
            return [shard.astype(np.int32), slot]

        return compute

    return append_columns(numbered.withColumn("row", F.col("row").cast("long")), "row", "shard int, slot long", make, 1 << 14)
