import datetime
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohorta.operators import ranking as R
from cohorta.operators.slicing import number_rows, value_slices


def frame(spark, n=3000, hot=0.35, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "row_id": rng.permutation(n),
        "cohort": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]),
        "score": np.where(rng.random(n) < hot, 7.0, np.round(rng.normal(5, 3, n), 1)),
    })
    pdf.loc[rng.random(n) < 0.1, "score"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "cohort"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "row_id long, cohort string, score double")
    return pdf, df


@pytest.mark.parametrize("method", R.TIE_METHODS)
@pytest.mark.parametrize("hot", [0.0, 0.35, 1.0])
def test_ranks_equal_pandas(spark, method, hot):
    pdf, df = frame(spark, hot=hot)
    got = R.add_ranks(df, "score", "row_id", ["cohort"], (method,), slices=10).toPandas()
    got = got.set_index("row_id")[f"rank_{method}"].sort_index().astype(float)
    pdf = pdf.set_index("row_id").sort_index()
    want = pdf["score"].groupby(pdf["cohort"].fillna("?")).rank(ascending=False, method=method)
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_all_methods_from_one_call_and_without_groups(spark):
    pdf, df = frame(spark, n=800)
    got = R.add_ranks(df, "score", "row_id", methods=R.TIE_METHODS, slices=5).toPandas()
    got, pdf = got.set_index("row_id").sort_index(), pdf.set_index("row_id").sort_index()
    for method in R.TIE_METHODS:
        want = pdf["score"].rank(ascending=False, method=method)
        pd.testing.assert_series_equal(got[f"rank_{method}"].astype(float), want, check_names=False)


def test_unknown_method_fails(spark):
    with pytest.raises(ValueError):
        R.add_ranks(spark.range(1), "id", "id", methods=("best",))


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "row_id long, score double")
    assert R.add_ranks(empty, "score", "row_id").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "row_id long, score double")
    assert [r["rank_average"] for r in R.add_ranks(nulls, "score", "row_id").collect()] == [None, None]


def test_no_task_holds_a_hot_value(spark):
    """A value held by 60 percent of the rows is cut into pieces of slice size."""
    df = spark.range(20_000).withColumn("score", F.when(F.col("id") % 10 < 6, 1.0).otherwise(F.col("id") * 1.0))
    cuts = value_slices(df, "score", 20)
    assert len(cuts.heavy) == 1
    rows = R._add_piece(cuts.assign(df.withColumn("__score", F.col("score")), "__score", "__slice"), cuts, "id", 20)
    largest = rows.groupBy("__slice", "__piece").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 20_000 / 20


def test_more_rows_cut_finer_slices(spark, monkeypatch):
    from cohorta.operators import slicing

    pdf, df = frame(spark, n=2000)
    coarse = value_slices(df, "score").count
    monkeypatch.setattr(slicing, "ROWS_PER_SLICE", 50)
    monkeypatch.setattr(slicing, "SAMPLE_ROWS", 1000)
    assert value_slices(df, "score").count > 2 * coarse
    got = R.add_ranks(df, "score", "row_id", methods=("average",)).toPandas().set_index("row_id").sort_index()
    want = pdf.set_index("row_id").sort_index()["score"].rank(ascending=False)
    pd.testing.assert_series_equal(got["rank_average"], want, check_names=False)


def test_number_rows_is_a_total_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    rows = number_rows(df, ["x"], "n").collect()
    assert sorted((r["x"], r["n"]) for r in rows) == [(i, i + 1) for i in range(5000)]


def test_rank_table_is_descending_competition_rank(spark):
    df = spark.createDataFrame([(1, 9.0), (2, 9.0), (3, 5.0), (4, None)], "id long, s double")
    rows = R.rank_table(df, "s", "id").collect()
    assert sorted((r["score"], r["rank"]) for r in rows) == [(5.0, 3), (9.0, 1), (9.0, 1)]


def test_sort_and_index(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 2.0)], "id long, s double")
    assert [r["id"] for r in R.sort_by_score(df, "s", "id").collect()] == [3, 1, 4, 2]
    indexed = R.sort_by_score(df, "s", "id", index="i").collect()
    assert [(r["id"], r["i"]) for r in indexed] == [(3, 0), (1, 1), (4, 2), (2, 3)]


def test_pages(spark, monkeypatch):
    df = spark.range(100)
    assert [r["id"] for r in R.paginate(df, "id", 95, 10).collect()] == [95, 96, 97, 98, 99]
    assert R.paginate(df, "id", 200, 10).count() == 0
    assert R.paginate(df, "id").count() == 100
    monkeypatch.setattr(R, "TOP_K_ROWS", 5)
    assert sorted(r["id"] for r in R.paginate(df, "id", 40, 10).collect()) == list(range(40, 50))


def test_null_scores(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "id long, s double")
    assert [r["id"] for r in R.null_scores(df, ["s"]).collect()] == [1]


def test_negative_zero_ties_with_zero(spark):
    df = spark.createDataFrame([(k, 0.0 if k else -0.0) for k in range(51)] + [(60, 1.0), (61, -1.0)], "id long, s double")
    for row in R.add_ranks(df, "s", "id", methods=("min", "max", "dense", "average")).where("s = 0").collect():
        assert (row["rank_min"], row["rank_max"], row["rank_dense"], row["rank_average"]) == (2, 52, 2, 27.0)


def test_deep_pages_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(R, "TOP_K_ROWS", 10)
    df = spark.range(1000).withColumn("k", 999 - F.col("id"))
    assert [r["k"] for r in R.paginate(df, "k", 500, 300).collect()] == list(range(500, 800))


def test_hot_scores_with_clustered_ids_are_split(spark):
    # Two hot scores, each with neighbouring ids, among many others.
    df = spark.range(40_000).select(
        "id", F.when(F.col("id") < 8_000, 5.0).when(F.col("id") < 14_000, 6.0).otherwise(F.col("id") * 1.0).alias("s")
    )
    cuts = R.value_slices(df.withColumnRenamed("s", "__score"), "__score", 20)
    placed = R._add_piece(cuts.assign(df.withColumnRenamed("s", "__score"), "__score", "__slice"), cuts, "id", 20)
    largest = placed.groupBy("__slice", "__piece").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 40_000 / 20
    got = {r["id"]: r["rank_first"] for r in R.add_ranks(df, "s", "id", methods=("first",), slices=20).collect()}
    order = sorted(df.collect(), key=lambda r: (-r["s"], r["id"]))
    assert got == {r["id"]: n for n, r in enumerate(order, 1)}


def _ranked(spark, rows, kind, methods=R.TIE_METHODS):
    df = spark.createDataFrame(rows, f"id long, k string, s {kind}, __score int")
    return R.add_ranks(df, "s", "id", by=["k"], methods=methods)


@pytest.mark.parametrize("kind", ["long", "decimal(38,6)", "date", "timestamp", "boolean"])
def test_ranks_in_the_scores_own_type(spark, kind):
    rng = random.Random(5)
    day = datetime.date(2000, 1, 1)
    value = {
        "long": lambda n: 2**53 + n,
        "decimal(38,6)": lambda n: Decimal(10**25) + Decimal(n) / 10**6,
        "date": lambda n: day + datetime.timedelta(n),
        "timestamp": lambda n: datetime.datetime(2000, 1, 1) + datetime.timedelta(microseconds=n),
        "boolean": lambda n: bool(n % 2),
    }[kind]
    rows = [(i, rng.choice(["a", "b", None]), value(rng.choice([0, 0, 1, 2, 3, 9])) if i % 7 else None, 1) for i in range(200)]
    got = _ranked(spark, rows, kind)
    assert got.columns == ["id", "k", "s", "__score", *[f"rank_{m}" for m in R.TIE_METHODS]]
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, k, s, _ in rows:
        peers = sorted((r for r in rows if r[1] == k and r[2] is not None), key=lambda r: (-order_key(r[2]), r[0]))
        r = found[i]
        if s is None:
            assert all(r[f"rank_{m}"] is None for m in R.TIE_METHODS)
            continue
        above = sum(order_key(p[2]) > order_key(s) for p in peers)
        ties = sum(p[2] == s for p in peers)
        assert (r["rank_min"], r["rank_max"], r["rank_average"]) == (above + 1, above + ties, above + (ties + 1) / 2)
        assert r["rank_first"] == [p[0] for p in peers].index(i) + 1
        assert r["rank_dense"] == 1 + len({p[2] for p in peers if order_key(p[2]) > order_key(s)})


def order_key(value):
    if isinstance(value, datetime.datetime):
        return (value - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    return value.toordinal() if isinstance(value, datetime.date) else value


def test_own_type_without_groups_or_rows(spark):
    df = spark.createDataFrame([(1, 2**53), (2, 2**53 + 1), (3, None)], "id long, s long")
    got = {r["id"]: r["rank_min"] for r in R.add_ranks(df, "s", "id", methods=("min",)).collect()}
    assert got == {1: 2, 2: 1, 3: None}
    assert R.add_ranks(df.limit(0), "s", "id", methods=R.TIE_METHODS).count() == 0
    assert R.rank_table(df, "s", "id").count() == 2
