"""Page directories and frozen state: what is prepared is not prepared again."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohorta.operators.asof import asof_lookup
from cohorta.operators.features import FeatureStats, fit_feature_stats
from cohorta.operators.pages import count_rows, read_page, write_pages
from cohorta.operators.ranking import rank_table
from cohorta.plans import frozen
from cohorta.plans.frozen import freeze, prepare_ranks, thaw
from cohorta.streaming.score import read_arrivals, read_scored, score_stream


def jobs_of(spark, work):
    """What ``work`` gives, and how many jobs it started."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = work()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(50), None if i % 11 == 0 else "x" * (i % 4)) for i in range(1000)]
    return spark.createDataFrame(rows, "id long, v int, part string").repartition(7)


def test_pages_follow_each_other(spark, numbers, tmp_path):
    root = str(tmp_path / "p")
    assert write_pages(numbers, [F.desc("v"), "id"], root) == 1 and count_rows(spark, root) == 1000
    want = [tuple(r) for r in numbers.orderBy(F.desc("v"), "id").collect()]
    got = []
    for skip in range(0, 1100, 130):
        page = read_page(spark, root, skip, 130)
        assert page.columns == numbers.columns
        got += [tuple(r) for r in page.collect()]
    assert got == want
    assert read_page(spark, root, 5000, 10).count() == 0 and read_page(spark, root, 0, 0).count() == 0


def test_a_page_opens_its_own_folders_only(spark, numbers, tmp_path):
    root = str(tmp_path / "p")
    write_pages(numbers, ["id"], root)
    page, jobs = jobs_of(spark, lambda: read_page(spark, root, 990, 10))
    assert jobs == 0
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(id" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)
    opened = page.select(F.input_file_name()).distinct().collect()
    assert len(opened) <= 2


def test_pages_of_a_version_stay(spark, numbers, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        read_page(spark, root)
    write_pages(numbers, ["id"], root)
    write_pages(numbers.where("id < 5"), [F.desc("id")], root)
    assert [r["id"] for r in read_page(spark, root, 0, 2).collect()] == [4, 3]
    assert [r["id"] for r in read_page(spark, root, 998, 9, version=1).collect()] == [998, 999]
    write_pages(numbers.limit(0), ["id"], root)
    assert read_page(spark, root).count() == 0


SCORES = [(1, 10.0), (2, 20.0), (3, 20.0), (4, -0.0), (5, None), (6, float("nan")), (7, float("inf")), (8, 35.5)]
PROBES = [(i, s) for i, s in enumerate([5.0, 0.0, -0.0, -1.0, 10.0, 19.9, 20.0, 1e9, float("inf"), float("nan"), None])]


@pytest.mark.parametrize(("miss", "buckets", "small"), [(0, None, 100), (None, 2, 100), (0, 3, 0)])
def test_prepared_ranks_answer_like_the_lookup(spark, tmp_path, monkeypatch, miss, buckets, small):
    monkeypatch.setattr(frozen, "SMALL_TABLE_ROWS", small)
    table = rank_table(spark.createDataFrame(SCORES, "id long, s double"), "s", "id")
    probes = spark.createDataFrame(PROBES, "id long, p double")
    want = {r["id"]: r["r"] for r in asof_lookup(probes, table, "p", "score", "rank", "r", "id", miss=miss).collect()}
    prepared = prepare_ranks(table, miss=miss, buckets=buckets)
    root = str(tmp_path / "s")
    assert freeze(spark, root, prepared) == 1
    for ranks in (prepared, thaw(spark, root).ranks):
        found, jobs = jobs_of(spark, lambda r=ranks: r.lookup(probes, "p", "r"))
        assert jobs == 0 and found.columns == ["id", "p", "r"]
        assert {r["id"]: r["r"] for r in found.collect()} == want


def test_empty_rank_table(spark):
    prepared = prepare_ranks(spark.createDataFrame([], "score double, rank long"))
    got = prepared.lookup(spark.createDataFrame(PROBES, "id long, p double"), "p", "r").collect()
    assert {r["r"] for r in got if r["p"] is not None} == {0}


def test_state_is_versioned(spark, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        thaw(spark, root)
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", None, 5.0)], "academie string, serie string, moy_gle double")
    first = fit_feature_stats(df, labels=("serie",), group_columns={"academie_perf": "academie"})
    freeze(spark, root, stats={"m": first})
    freeze(spark, root, stats={"m": FeatureStats()})
    old, new = thaw(spark, root, 1), thaw(spark, root)
    assert new.version == 2 and new.stats["m"].codes is None and new.stats["m"].means == {} and new.ranks is None
    assert sorted(map(tuple, old.stats["m"].means["academie_perf"].collect())) == [("a", 2.0), ("b", 5.0)]
    assert sorted(r["label"] for r in old.stats["m"].codes.collect()) == ["nan", "x", "y"]


def test_stream_starts_no_job_on_the_rank_table(spark, tmp_path):
    table = rank_table(spark.createDataFrame(SCORES, "id long, s double"), "s", "id")
    root, arriving, sink, rejects = (str(tmp_path / n) for n in ("s", "in", "out", "bad"))
    freeze(spark, root, prepare_ranks(table))
    spark.createDataFrame(PROBES, "id long, p double").write.parquet(arriving)
    state, planned = thaw(spark, root), []

    def score(batch):
        found, jobs = jobs_of(batch.sparkSession, lambda: state.ranks.lookup(batch, "p", "r"))
        planned.append(jobs)
        return found

    arrivals = read_arrivals(spark, arriving, spark.read.parquet(arriving).schema)
    score_stream(arrivals, score, sink, str(tmp_path / "c"), rejects=rejects, usable=F.col("r") > 0).awaitTermination()
    assert planned and set(planned) == {0}
    good, bad = read_scored(spark, sink), read_scored(spark, rejects)
    assert good.count() + bad.count() == len(PROBES) and good.where("r <= 0").count() == 0
    assert bad.where("r > 0").count() == 0 and bad.where("r IS NULL").count() == 1


def test_a_miss_may_get_the_last_rank(spark):
    table = rank_table(spark.createDataFrame(SCORES, "id long, s double"), "s", "id")
    probes = spark.createDataFrame(PROBES, "id long, p double")
    for found in (
        asof_lookup(probes, table, "p", "score", "rank", "r", "id", miss="last"),
        prepare_ranks(table, miss="last").lookup(probes, "p", "r"),
    ):
        got = {r["id"]: r["r"] for r in found.collect()}
        assert got[3] == got[9] == probes.sparkSession.createDataFrame(table.collect()).agg(F.max("rank")).first()[0]
        assert got[10] is None and got[5] == got[4]
    empty = table.limit(0)
    assert prepare_ranks(empty, miss="last").lookup(probes, "p", "r").where("r IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="first"):
        asof_lookup(probes, table, "p", "score", "rank", "r", "id", miss="first")
