"""Hard negatives against brute force: ties, copies, few positives, negative scores, unfit rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import hard_negatives
from cohorta.llm.hard_negatives import MultiIndex, mine_hard_negatives

VECS = "vec_id long, embedding array<double>, label int"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=10, k=5, scale=256):
    use = [
        (i, np.floor(scale * np.array(v)), lab) for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    width = max((len(v) for _, v, _ in use), default=0)
    use = [(i, np.pad(v, (0, width - len(v))), lab) for i, v, lab in use]
    out = []
    for a, v, lab in use:
        if a % every:
            continue
        scored = [(-int(v @ w), i, m) for i, w, m in use if i != a]
        for p, i in sorted((s, i) for s, i, m in scored if m == lab)[:k]:
            fit = sorted((s, j) for s, j, m in scored if m != lab and 80 * -p <= 100 * -s <= 100 * -p)[:k]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    got = mine_hard_negatives(spark.createDataFrame(rows, VECS), anchor_every=every, **options)
    assert got.columns == OUT
    return sorted(map(tuple, got.collect()))


def random_rows(seed, count, width=9, labels=4, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    label = rng.integers(0, labels, count)
    vectors = centres[label] * spread + rng.normal(size=(count, width)) * 0.2
    return [(int(i), v.tolist(), int(lab)) for i, v, lab in zip(rng.permutation(count), vectors, label)]


def test_walk_is_by_falling_bound():
    rng = np.random.default_rng(1)
    index = MultiIndex((rng.normal(size=(6, 3)), rng.normal(size=(5, 2))), (rng.random(6), rng.random(5)))
    seen = list(index.visit(rng.normal(size=5)))
    assert len({s[:2] for s in seen}) == 30 and all(a[2] >= b[2] for a, b in itertools.pairwise(seen))


@pytest.mark.parametrize("lane", [16, 2048])
def test_against_brute_force(spark, monkeypatch, lane):
    monkeypatch.setattr(hard_negatives, "LEAST_LANE", lane)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 8)
    for seed, width, spread in ((1, 9, 0.1), (2, 2, 1.0), (3, 1, 0.0)):
        rows = random_rows(seed, 300, width=width, spread=spread)
        assert mined(spark, rows) == brute(rows)


def test_a_third_alike(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_LANE", 16)
    rows = random_rows(4, 200)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(120)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 0


def test_unfit_rows_ties_and_few_positives(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.1], 2), (4, [0.9], 2),
        (10, [-1.0, 0.0], 3), (11, [1.0, 0.0], 3), (20, [0.0, 0.0], 4), (21, [0.5, 0.0], 4), (30, [1.0, 1.0], 9),
        (40, None, 1), (50, [1.0, None], 1), (60, [nan, 1.0], 1), (70, [inf, 1.0], 1), (80, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
    ]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} >= {0, 20}


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.95, 0.0], 2), (2, [0.85, 0.0], 2)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert mine_hard_negatives(spark.createDataFrame([], VECS)).collect() == []
    rows = random_rows(6, 80)
    df = spark.createDataFrame(rows, VECS).selectExpr("*", "1 AS lane", "2 AS row", "3 AS windows", "4 AS place")
    got = mine_hard_negatives(df, anchor_every=10, label=F.col("label"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
