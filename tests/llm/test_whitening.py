"""Rank-one spectra against a dense solver; whitening against numpy on all rows."""

import numpy as np
import pytest

from cohorta.llm.whitening import Spectrum, fit_whitening, secular_roots, whiten

VECS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("name", ["plain", "whole", "few", "onehot", "scales", "two", "one"])
def test_spectrum(name):
    rng = np.random.default_rng(3)
    rows = {
        "plain": rng.normal(size=(200, 24)),
        "whole": np.floor(rng.normal(size=(200, 24)) * 4),
        "few": np.repeat(rng.normal(size=(5, 12)), 20, axis=0),
        "onehot": np.eye(15)[rng.integers(0, 15, 200)],
        "scales": rng.normal(size=(200, 12)) * 10.0 ** np.arange(-6, 6),
        "two": np.concatenate([np.zeros((5, 8)), np.full((200, 8), 1e6)]),
        "one": rng.normal(size=(40, 1)),
    }[name]
    whole, left, right = (Spectrum.empty(rows.shape[1]) for _ in range(3))
    for i, row in enumerate(rows):
        whole.add(row)
        (left if i % 3 else right).add(row)
    left.merge(Spectrum.from_bytes(right.to_bytes(), rows.shape[1]))
    centred = rows - rows.mean(axis=0)
    scatter = centred.T @ centred
    for s in (whole, left):
        assert s.rows == len(rows) and np.allclose(s.mean, rows.mean(axis=0))
        assert abs(s.vectors.T @ s.vectors - np.eye(rows.shape[1])).max() < 1e-12
        assert abs(s.vectors * s.values @ s.vectors.T - scatter).max() < 1e-11 * abs(scatter).max()


def test_no_rows():
    s = Spectrum.empty(3)
    s.merge(Spectrum.empty(3))
    assert s.rows == 0 and (s.values == 0).all()


def test_secular_roots_lie_between_poles():
    rng = np.random.default_rng(5)
    poles, weights = np.sort(rng.normal(size=30)), rng.random(30) ** 8 + 1e-12
    near, x = secular_roots(poles, weights)
    roots = poles[near] + x
    want = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.allclose(roots, want, atol=1e-12) and (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()


def expected(vectors, scale=64, offset=1_000_000, count=16):
    x = np.floor(scale * np.array(vectors, float)).astype(np.int64) + offset
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    trace = (y**2).sum() / n
    return n, ((n * x - sums) ** 2).sum(axis=1), ((n * x - sums) / n) @ axes / np.sqrt(values), values / trace


def test_against_numpy(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 20)) * np.arange(1, 21)
    vectors[200:] = vectors[5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    unfit = [(900, None, 1), (901, [None] + [0.0] * 19, 1), (902, [float("nan")] + [0.0] * 19, 1), (903, [float("inf")] * 20, 1)]
    got = whiten(spark.createDataFrame(rows + unfit, VECS)).toPandas()
    n, deviations, whitened, explained = expected(vectors)
    assert n == 200 and set(got["n"]) == {200} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    wide = got.pivot(index="id", columns="component", values="whitened")
    assert list(wide.index) == list(range(300)) and list(wide.columns) == list(range(1, 17))
    signs = np.sign((wide.to_numpy() * whitened).sum(axis=0))
    assert abs(wide.to_numpy() * signs - whitened).max() < 1e-9
    first = got[got["component"] == 1].set_index("id").sort_index()
    assert [int(d) for d in first["deviation"]] == deviations.tolist()
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-10)


def test_equal_short_null_and_repeated(spark):
    same = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    assert whiten(spark.createDataFrame(same, VECS)).count() == 0
    assert whiten(spark.createDataFrame([], VECS)).count() == 0
    assert whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], VECS)).count() == 0
    # A short vector ends in zeros and equals the one that says so; ids null and repeated stay rows.
    rows = [(1, [1.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 3.0], 0), (4, [2.0, 1.0], 0)]
    got = whiten(spark.createDataFrame(rows, VECS).selectExpr("*", "1 AS x", "2 AS part", "3 AS id")).toPandas()
    assert set(got["n"]) == {3} and len(got) == 8 and got["id"].isna().sum() == 2
    one = got[got["id"] == 1].groupby("component")["whitened"].nunique()
    assert (one == 1).all()


def test_large_entries(spark):
    rows = [(1, [1e12, 0.0], 0), (2, [-1e12, 1.0], 0), (3, [1e300, 1.0], 0), (4, [0.0, 5.0], 0)]
    got = whiten(spark.createDataFrame(rows, VECS)).toPandas()
    x = np.array([[64 * 10**12, 0], [-64 * 10**12, 64], [0, 320]], dtype=object)
    sums = x.sum(axis=0)
    want = [int(((3 * r - sums) ** 2).sum()) for r in x]
    first = got[got["component"] == 1].set_index("id")["deviation"]
    assert [int(first[i]) for i in (1, 2, 4)] == want


def test_fit_is_the_same_for_any_partitions(spark):
    rng = np.random.default_rng(9)
    import pandas as pd

    packed = [(i, np.floor(v).astype("<i8").tobytes()) for i, v in enumerate(rng.normal(size=(500, 8)) * 50)]
    df = spark.createDataFrame(pd.DataFrame(packed, columns=["id", "x"]))
    few, many = fit_whitening(df.coalesce(1), 4), fit_whitening(df.repartition(40), 4)
    assert np.allclose(few.values, many.values, rtol=1e-12) and np.allclose(few.components, many.components, atol=1e-9)
