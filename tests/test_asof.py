import math

import numpy as np
import pytest

from cohorta.operators.asof import asof_lookup

WAYS = {"broadcast": 100_000, "sliced": 0}


def brute(score, table, miss):
    if score is None:
        return None
    below = [(s, v) for s, v in table if s <= score]
    if not below:
        return miss
    value = max(below, key=lambda p: p[0])[1]
    return miss if value is None else value


def run(spark, probes, table, small_rows, miss=0):
    left = spark.createDataFrame(list(enumerate(probes)), "row_id long, p double")
    right = spark.createDataFrame(table, "score double, rank long")
    out = asof_lookup(left, right, "p", "score", "rank", "found", "row_id", miss=miss, small_rows=small_rows, slices=7)
    assert out.columns == ["row_id", "p", "found"]
    rows = out.collect()
    assert len(rows) == len(probes)
    return [r["found"] for r in sorted(rows, key=lambda r: r["row_id"])]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("miss", [0, None])
def test_edges(spark, way, miss):
    table = [(1.0, 30), (2.0, 20), (3.0, None), (5.0, 1)]
    probes = [0.5, 1.0, 1.5, 2.0, 2.999, 3.0, 4.0, 5.0, 99.0, None, -math.inf, math.inf]
    want = [brute(p, table, miss) for p in probes]
    assert run(spark, probes, table, WAYS[way], miss) == want


@pytest.mark.parametrize("way", WAYS)
def test_infinite_table_scores_and_nan(spark, way):
    table = [(-math.inf, 9), (1.0, 5), (math.inf, 2)]
    probes = [-math.inf, 0.0, 1.0, 7.0, math.inf, math.nan]
    assert run(spark, probes, table, WAYS[way]) == [9, 9, 5, 5, 2, 0]


@pytest.mark.parametrize("way", WAYS)
def test_random_with_a_hot_probe_and_many_nulls(spark, way):
    rng = np.random.default_rng(3)
    table = [(float(s), int(i)) for i, s in enumerate(rng.choice(1000, 60, replace=False))]
    probes = [float(x) for x in rng.integers(-50, 1100, 1200)]
    probes = [500.0 if rng.random() < 0.4 else p for p in probes]
    probes = [None if rng.random() < 0.2 else p for p in probes]
    assert run(spark, probes, table, WAYS[way]) == [brute(p, table, 0) for p in probes]


@pytest.mark.parametrize("way", WAYS)
def test_empty_table(spark, way):
    assert run(spark, [1.0, None], [], 1 if way == "broadcast" else -1) == [0, None]


def test_equal_table_scores_give_the_lowest_rank(spark):
    assert run(spark, [2.0], [(2.0, 7), (2.0, 4)], 10) == [4]


def test_text_scores_are_cleaned(spark):
    probes = spark.createDataFrame([(1, " 12.5 "), (2, "x")], "row_id long, p string")
    table = spark.createDataFrame([(" 12 ", " 3"), ("bad", "1")], "score string, rank string")
    rows = asof_lookup(probes, table, "p", "score", "rank", "found", "row_id").collect()
    assert {r["row_id"]: r["found"] for r in rows} == {1: 3, 2: None}


def test_negative_zero_and_a_nan_rank(spark):
    table = spark.createDataFrame([(-1.0, 3.0), (0.0, 2.0), (1.0, 1.0), (2.0, float("nan"))], "score double, rank double")
    probes = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.5), (4, 5.0)], "id long, score double")
    for small_rows in (100, 0):
        got = asof_lookup(probes, table, "score", "score", "rank", "out", "id", small_rows=small_rows)
        assert {r["id"]: r["out"] for r in got.collect()} == {1: 2, 2: 2, 3: 3, 4: 0}
