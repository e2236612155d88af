import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cohorta.operators import hierarchy as H
from cohorta.sources.tables import read_hierarchy_documents
from cohorta.sources.versions import VersionLog

DOC = {"R2": {"A2": ["p", "o"], "A1": []}, "R1": {"A3": ["n"]}, "R0": {}}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs") / "h.json"
    path.write_text(json.dumps(DOC, indent=2), encoding="utf-8")
    return H.flatten_documents(read_hierarchy_documents(spark, str(path)))


def ids(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("id").collect()]


def test_ids_follow_the_document(tables):
    assert ids(tables["regions"], "id", "name") == [(1, "R2"), (2, "R1"), (3, "R0")]
    assert ids(tables["academies"], "id", "name", "region_id") == [(1, "A2", 1), (2, "A1", 1), (3, "A3", 2)]
    assert ids(tables["residences"], "id", "name", "academie_id") == [(1, "p", 1), (2, "o", 1), (3, "n", 3)]


def test_names_met_again_in_a_later_document(spark):
    docs = spark.createDataFrame(
        [(1, json.dumps({"R": {"A": ["x"]}})), (2, json.dumps({"S": {}, "R": {"A": ["y", "x"], "B": []}}))], "doc long, text string"
    )
    out = H.flatten_documents(docs)
    assert ids(out["regions"], "id", "name") == [(1, "R"), (2, "S")]
    assert ids(out["academies"], "id", "name") == [(1, "A"), (2, "B")]
    assert ids(out["residences"], "id", "name") == [(1, "x"), (2, "y")]


def test_broken_document_fails(spark):
    docs = spark.createDataFrame([(1, '{"R": {"A": ["x"')], "doc long, text string")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        H.flatten_documents(docs)["regions"].collect()


def nested(df):
    return {
        (r["region"], r["page"]): [(a["name"], a["residences"]) for a in r["academies"]] for r in df.collect()
    }


def test_nesting_keeps_parents_without_children(tables):
    got = nested(H.nest_regions(tables["regions"], tables["academies"], tables["residences"]))
    assert got == {("R2", 0): [("A2", ["p", "o"]), ("A1", [])], ("R1", 0): [("A3", ["n"])], ("R0", 0): []}


def test_long_regions_continue_on_further_pages(spark):
    regions = spark.createDataFrame([(1, "R"), (2, "S")], "id long, name string")
    academies = spark.createDataFrame([(1, "A", 1), (2, "B", 1), (3, "C", 2)], "id long, name string, region_id long")
    residences = spark.range(7).select(
        "id", F.concat(F.lit("r"), F.col("id")).alias("name"), F.when(F.col("id") < 5, 1).when(F.col("id") < 6, 2).otherwise(3).alias("academie_id")
    )
    got = nested(H.nest_regions(regions, academies, residences, page_rows=3))
    assert got == {
        ("R", 0): [("A", ["r0", "r1", "r2"])], ("R", 1): [("A", ["r3", "r4"]), ("B", ["r5"])], ("S", 0): [("C", ["r6"])],
    }


def test_refresh_replaces_and_survives_a_failed_one(spark, tmp_path, tables):
    root = str(tmp_path / "h")
    with pytest.raises(FileNotFoundError):
        H.read_hierarchy(spark, root)
    assert H.refresh_hierarchy(spark, tables, root) == 1
    bad = tables["residences"].withColumn("name", F.raise_error("broken source"))
    with pytest.raises(Exception, match="broken source"):
        H.refresh_hierarchy(spark, {**tables, "residences": bad}, root)
    assert H.read_hierarchy(spark, root)["residences"].count() == 3
    assert H.refresh_hierarchy(spark, {n: df.where("id = 1") for n, df in tables.items()}, root) == 2
    assert {n: df.count() for n, df in H.read_hierarchy(spark, root).items()} == {"regions": 1, "academies": 1, "residences": 1}


def test_append_ids_duplicates_and_orphans(spark, tables):
    incoming = spark.createDataFrame(
        [(5, "new", 1), (3, "new", 2), (4, "p", 1), (6, "lost", 99), (7, "late", 3), (2, "lost", 1)],
        "seq long, name string, academie_id long",
    )
    accepted, rejected = H.append_entries(tables["residences"], incoming, tables["academies"], "academie_id")
    # The orphan "lost" does not block the valid "lost".
    assert ids(accepted, "id", "name", "academie_id") == [(4, "lost", 1), (5, "new", 2), (6, "late", 3)]
    assert {r["seq"]: r["reason"] for r in rejected.collect()} == {5: "repeated_in_batch", 4: "name_exists", 6: "unknown_parent"}


def test_append_to_an_empty_top_level(spark):
    none = spark.createDataFrame([], "id long, name string")
    accepted, rejected = H.append_entries(none, spark.createDataFrame([(1, "R")], "seq long, name string"))
    assert ids(accepted, "id", "name") == [(1, "R")]
    assert rejected.count() == 0


def test_lookups(spark, tables):
    wanted = spark.createDataFrame([(1,), (9,)], "id long")
    assert {r["id"]: (r["name"], r["found"]) for r in H.lookup_by_id(tables["regions"], wanted).collect()} == {1: ("R2", True), 9: (None, False)}
    academies = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    kids = H.children_of_parents(academies, tables["academies"], tables["residences"], "academie_id")
    assert sorted((r["parent_id"], r["child_name"] or "") for r in kids.collect()) == [(1, "o"), (1, "p"), (2, "")]
    assert [r["id"] for r in H.unknown_parents(academies, tables["academies"]).collect()] == [9]
    assert H.count_tables(tables).first().asDict() == {"total_regions": 3, "total_academies": 3, "total_residences": 3}


def test_refresh_rejects_a_name_under_two_parents(spark, tmp_path, tables):
    root = str(tmp_path / "h")
    H.refresh_hierarchy(spark, tables, root)
    docs = spark.createDataFrame([(1, json.dumps({"R": {"A": ["x"]}, "S": {"A": ["y"]}}))], "doc long, text string")
    with pytest.raises(ValueError, match="academies: 'A' occurs 2 times"):
        H.refresh_hierarchy(spark, H.flatten_documents(docs), root)
    assert H.read_hierarchy(spark, root)["academies"].count() == 3


def test_two_refreshes_at_once_are_both_committed(spark, tmp_path, tables, monkeypatch):
    root = str(tmp_path / "h")
    few = {n: df.where("id = 1") for n, df in tables.items()}
    seen = VersionLog.latest
    raced = []

    def late(log):
        # Another writer commits between this one's look and its commit.
        found = seen(log)
        if not raced:
            raced.append(1)
            assert H.refresh_hierarchy(spark, few, root) == 1
        return found

    monkeypatch.setattr(VersionLog, "latest", late)
    assert H.refresh_hierarchy(spark, tables, root) == 2
    assert VersionLog(spark, root).versions() == [1, 2]
    assert tuple(df.count() for df in H.read_hierarchy(spark, root).values()) == (3, 3, 3)


def test_two_appends_at_once_keep_ids_and_names_unique(spark, tmp_path, tables, monkeypatch):
    root = str(tmp_path / "h")
    H.refresh_hierarchy(spark, tables, root)
    mine, other = (
        spark.createDataFrame(rows, "seq long, name string, academie_id long")
        for rows in ([(1, "new", 1), (2, "mine", 1)], [(1, "new", 2), (2, "other", 1)])
    )
    seen, raced = VersionLog.latest, []

    def late(log):
        found = seen(log)
        if not raced:
            raced.append(1)
            H.append_hierarchy(spark, root, "residences", other, "academies", "academie_id")
        return found

    monkeypatch.setattr(VersionLog, "latest", late)
    version, rejected = H.append_hierarchy(spark, root, "residences", mine, "academies", "academie_id")
    rows = H.read_hierarchy(spark, root)["residences"].collect()
    assert version == 3 and [(r["name"], r["reason"]) for r in rejected.collect()] == [("new", "name_exists")]
    assert len(rows) == len({r["id"] for r in rows}) == len({r["name"] for r in rows}) == 6
    assert {"new", "mine", "other"} <= {r["name"] for r in rows}


def test_many_writers_at_once(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))

    def add(n):
        return log.update(lambda version, content: {"seen": [*content.get("seen", []), n]})

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(add, range(16))) == list(range(1, 17))
    assert sorted(log.latest()[1]["seen"]) == list(range(16))
    assert not log.commit(3, {}) and log.read(1) != {}
    assert [n for n in os.listdir(tmp_path / "log" / "_versions") if "draft" in n] == []


def test_expiry_keeps_what_versions_and_young_writers_need(spark, tmp_path, tables):
    root = str(tmp_path / "h")
    few = {n: df.where("id = 1") for n, df in tables.items()}
    H.refresh_hierarchy(spark, few, root)
    H.refresh_hierarchy(spark, tables, root)
    more = spark.createDataFrame([(1, "R9")], "seq long, name string")
    assert H.append_hierarchy(spark, root, "regions", more)[0] == 3
    assert H.expire_hierarchy(spark, root, keep=1) == []
    H.refresh_hierarchy(spark, few, root)
    assert len(H.expire_hierarchy(spark, root, keep=1, min_age_seconds=0)) == 7
    assert {n: df.count() for n, df in H.read_hierarchy(spark, root).items()} == {"regions": 1, "academies": 1, "residences": 1}
    with pytest.raises(ValueError, match="last version"):
        H.expire_hierarchy(spark, root, keep=0)


def test_rejected_refresh_leaves_no_folders(spark, tmp_path, tables):
    root = str(tmp_path / "h")
    H.refresh_hierarchy(spark, tables, root)
    twice = {**tables, "regions": tables["regions"].unionByName(tables["regions"])}
    with pytest.raises(ValueError, match="occurs 2 times"):
        H.refresh_hierarchy(spark, twice, root)
    assert all(len(os.listdir(tmp_path / "h" / level)) == 1 for level in H.LEVELS)


@pytest.mark.parametrize("indent", [None, 2])
def test_split_documents_are_flattened_alike(spark, indent):
    odd = {'a "quoted" {name}': {"x, y": ["1", "2\\\\", '{"}'], "": []}, "é\n": {}, "[z]": {"q": ["1"]}}
    many = {f"R{i}": {f"A{i}-{j}": [f"r{i}-{j}-{k}" for k in range(50)] for j in range(20)} for i in range(40)}
    docs = spark.createDataFrame([(1, json.dumps(odd, indent=indent)), (2, json.dumps(many, indent=indent)), (3, "{}"), (4, None)], "doc long, text string")
    parts = H.split_documents(docs)
    assert parts.count() == 43 and parts.select(F.spark_partition_id()).distinct().count() > 1
    whole, split = (H.flatten_documents(docs, split_chars=n) for n in (1 << 30, 0))
    for level in H.LEVELS:
        assert sorted(map(tuple, whole[level].collect())) == sorted(map(tuple, split[level].collect()))


@pytest.mark.parametrize("text", ['{"R": {"A": ["x"]}', '{"R": {"A": ["x"]} "S": {}}', '{"R": 1}', "[]", '{"R": {"A": ["x"]}} x', '{"R": {"A": "x"}}'])
def test_malformed_documents_raise_when_split(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        H.flatten_documents(docs, split_chars=0)["regions"].collect()


def test_a_very_long_entry_takes_no_stack(spark):
    text = json.dumps({"R": {"A": ["x" * 200_000] + [f"n{i}" for i in range(30_000)]}})
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    assert H.flatten_documents(docs, split_chars=0)["residences"].count() == 30_001
