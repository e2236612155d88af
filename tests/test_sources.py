import json

import pytest
from pyspark.sql import functions as F

from cohorta import scratch
from cohorta.sources import records, tables
from cohorta.streaming.score import read_arrivals, read_scored, score_stream

HEADER = "REGION_DE_NAISSANCE,MENTION,Sexe,Mention,Moy. Gle,Année BAC,Académie de l'Ets. Prov.,Other thing"


@pytest.fixture()
def cohort_file(tmp_path):
    path = tmp_path / "c.csv"
    lines = [HEADER, ' Thies,,F,Pass,10.5,2018,"A, B",z', "NA,Bien,M,Bien,x,2017,A,", "Dakar,Passable,nan,ABien,,2018,A,w"]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_read_cohort_file(spark, cohort_file):
    df = tables.read_csv_table(spark, cohort_file, row_id="row_id")
    assert df.columns == ["region_naissance", "mention_l1", "sexe", "mention", "moy_gle", "annee_bac", "academie", "other_thing", "row_id"]
    rows = [tuple(r) for r in df.orderBy("row_id").collect()]
    # Leading spaces stay; blank-like texts and bad numbers are null.
    assert rows == [
        (" Thies", None, "F", "Pass", 10.5, 2018, "A, B", "z", 0),
        (None, "Bien", "M", "Bien", None, 2017, "A", None, 1),
        ("Dakar", "Passable", None, "ABien", None, 2018, "A", "w", 2),
    ]


def test_cohorts_stay_apart_and_numbered(spark, cohort_file):
    df = tables.read_cohorts(spark, {"one": cohort_file, "two": cohort_file})
    assert df.count() == 6
    assert {(r["cohort"], r["row_id"]) for r in df.collect()} == {(c, i) for c in ("one", "two") for i in range(3)}


def test_load_cohort_prepares(spark, cohort_file):
    row = tables.load_cohort(spark, cohort_file).where("annee_bac = 2017").first()
    assert (row["homme"], row["moy_gle"], row["academie_perf"]) == (1, 0.0, 0.0)


def test_rank_file_skips_spaces(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("Score L1, Rang L1\n 12.5, 1\n11, 2\nbad, 3\n", encoding="utf-8")
    rows = [tuple(r) for r in tables.read_rank_table(spark, str(path)).collect()]
    assert rows == [("12.5", "1"), ("11", "2"), ("bad", "3")]


def test_records_from_json_lines(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"Sexe": "F", "MATH": 12}) + "\n", encoding="utf-8")
    valid, rejected = records.split_valid(records.read_records(spark, str(path)))
    assert valid.count() == 0
    assert len(rejected.first()["missing"]) == 23


def test_materialize_writes_under_the_shared_folder(spark):
    df = scratch.materialize(spark.range(3), "t")
    folder = scratch.shared_folder(spark).removeprefix("file:")
    assert all(folder in f for f in df.inputFiles())
    assert df.count() == 3


def test_stream_takes_each_file_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = spark.range(1).schema

    def run():
        arrivals = read_arrivals(spark, source, schema, max_files=1)
        query = score_stream(arrivals, lambda b: b.withColumn("twice", F.col("id") * 2), sink, state)
        query.awaitTermination()
        return sorted(tuple(r) for r in read_scored(spark, sink).collect())

    spark.range(3).coalesce(1).write.parquet(source)
    assert run() == [(0, 0), (1, 2), (2, 4)]
    spark.range(3, 5).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(0, 0), (1, 2), (2, 4), (3, 6), (4, 8)]
    assert len(run()) == 5


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    (folder / "a.csv").write_text("FR,MATH,Année BAC\n10,20,2017\n", encoding="utf-8")
    (folder / "b.csv").write_text("MATH,FR\n7.5,8\n", encoding="utf-8")
    df = tables.read_csv_table(spark, str(folder), row_id="row_id")
    rows = [tuple(r) for r in df.select("row_id", "fr", "math", "annee_bac").orderBy("row_id").collect()]
    assert rows == [(0, 10.0, 20.0, 2017), (1, 8.0, 7.5, None)]


def test_numbers_that_do_not_fit_are_null(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("Année BAC,MATH\n17.5,17.5\n3000000000,1\nInfinity,2\n2018.0,3\n", encoding="utf-8")
    df = tables.read_csv_table(spark, str(path), row_id="row_id").orderBy("row_id")
    assert [tuple(r)[:2] for r in df.collect()] == [(None, 17.5), (None, 1.0), (None, 2.0), (2018, 3.0)]


def test_two_queries_share_a_sink(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(2).coalesce(1).write.parquet(source)
    for state in ("one", "two"):
        arrivals = read_arrivals(spark, source, spark.range(1).schema)
        score_stream(arrivals, lambda b: b, sink, str(tmp_path / state)).awaitTermination()
    assert sorted(r["id"] for r in read_scored(spark, sink).collect()) == [0, 0, 1, 1]
