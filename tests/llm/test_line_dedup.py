"""Line dedup against a brute-force version, on nulls, repeats, long texts and clashing names."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cohorta.llm.line_dedup import apply_bitmaps, dedup_lines, line_bitmaps

DOCS = "doc_id long, text string, lang string"


def brute(texts, min_documents, min_chars=1):
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))

    count = {}
    for text in texts:
        for k in {key(line) for line in (text or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and count[key(x)] >= min_documents)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def random_texts(seed, rows):
    rng = random.Random(seed)
    pool = ["Same line", " same LINE\t", "ÉTÉ", "été", "\x0b\x0cform feed\r", "", "  ", "x", "Ünique Ä"] + [f"line {i}" for i in range(40)]
    made = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(rows)]
    return [*made, None, "", "\n", "\n\n", "same line", "same line\n" * 500 + "end"]


def check(spark, texts, min_documents, min_chars=1):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, DOCS), min_documents, min_chars).collect()}
    for i, want in enumerate(brute(texts, min_documents, min_chars)):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == want, i


def test_against_brute_force(spark):
    for seed, least, chars in ((1, 3, 1), (2, 10, 1), (3, 2, 4), (4, 1, 0)):
        check(spark, random_texts(seed, 60), least, chars)


def test_a_third_of_all_rows_alike(spark):
    texts = random_texts(5, 20) + ["common head\nbody\ncommon tail"] * 40 + [f"common head\nown {i}" for i in range(30)]
    check(spark, texts, 10)


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rows = [(1, "a\nb", "en")] * 3 + [(None, "a\nc", "en")] * 2 + [(1, "a\nd", "fr"), (None, None, None)]
    got = dedup_lines(spark.createDataFrame(rows, DOCS), min_documents=6).collect()
    assert sorted((r["doc_id"] or 0, r["kept_text"]) for r in got) == [
        (0, ""), (0, "c"), (0, "c"), (1, "b"), (1, "b"), (1, "b"), (1, "d")
    ]


def test_long_texts_are_whole(spark):
    long = "shared\n" + "\n".join(f"own {i}" for i in range(100_000)) + "\nshared"
    check(spark, [long, "shared", "shared\nx", "y" * 1_000_000], 3)


def test_bitmaps_are_runs(spark):
    df = spark.createDataFrame([(1, "a\na\nx\na\ny", "en"), (2, "a", "en")], DOCS)
    found = {r["id"]: r for r in line_bitmaps(df, min_documents=2).collect()}
    assert [tuple(x) for x in found[1]["dropped"]] == [(0, 2), (3, 1)] and found[1]["n_dropped"] == 3
    assert [tuple(x) for x in found[2]["dropped"]] == [(0, 1)]
    assert {r["doc_id"]: r["kept_text"] for r in apply_bitmaps(df, line_bitmaps(df, 2)).collect()} == {1: "x\ny", 2: ""}


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, "a", "fr")], DOCS)
    clash = df.selectExpr("*", "7 AS row", "8 AS position", "'k' AS key1", "9 AS id", "1 AS `range`", "2 AS __bits", "3 AS __doc", "4 AS n_lines")
    got = dedup_lines(clash, min_documents=2)
    assert got.columns == [*clash.columns[:-1], "n_lines", "n_dropped", "kept_text"]
    assert sorted(map(tuple, got.collect())) == [
        (1, "a", "en", 7, 8, "k", 9, 1, 2, 3, 1, 1, ""), (2, "a", "fr", 7, 8, "k", 9, 1, 2, 3, 1, 1, "")
    ]
    assert dedup_lines(df.limit(0)).count() == 0


def test_query_digest(spark, tmp_path):
    from cohorta.llm.queries import op11_line_dedup

    texts = random_texts(7, 40)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op11_line_dedup(spark, str(tmp_path)).collect()}
    for i, (n, dropped, kept) in enumerate(brute(texts, 10)):
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (n, dropped)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a", "en")], DOCS)
    plan = dedup_lines(df.withColumn("n", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
