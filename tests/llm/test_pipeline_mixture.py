"""The mixture of the pipeline's fourth stage reaches the last one."""

from pyspark.sql import functions as F

import corpus_pipeline
from cohorta.llm.mixing import RESULTS, mix_sources

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string"
ROWS = [(k, f"text of number {k}", "en", "abc"[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2], 1, f"s{k}") for k in range(120)]
ROWS += [(None, None, None, None, None, None), (7, "text of number 7", "en", "b", 2, "x"), (7, "text of number 7", "en", "b", 2, "x"), (300, "", None, None, 0, "")]


def places(df):
    return sorted(map(tuple, df.select("doc_id", "lang", "source", *RESULTS).collect()), key=repr)


def test_the_last_stage_takes_the_places_of_the_mixture(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(5)
    mixed = corpus_pipeline.source_mixing(spark, docs, "")
    assert mixed.columns == docs.columns
    assert sorted(map(tuple, mixed.select("doc_id", "text", "lang", "source.source", "n_chars", "slot").collect()), key=repr) == sorted(ROWS, key=repr)
    order = [r["position"] for r in mixed.select("source.position").collect()]
    assert order == sorted(order) and len(set(order)) == len(ROWS)
    mixed.write.parquet(f"{tmp_path}/mixed")
    want = places(mix_sources(docs.select("doc_id", "lang", "source", "text")))

    def again(*_args, **_named):
        raise AssertionError("mixed again")

    monkeypatch.setattr(corpus_pipeline, "mix_sources", again)
    final = corpus_pipeline.bpe_encoding(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    assert final.columns[:8] == ["doc_id", "lang", "source", *RESULTS] and "text" not in final.columns
    assert places(final) == want
    # Another mixture gives another result, and none has no places.
    other = spark.read.parquet(f"{tmp_path}/mixed").withColumn("source", F.col("source").withField("position", -F.col("source.position")))
    assert {r["position"] for r in corpus_pipeline.bpe_encoding(spark, other, "").collect()} == {-p for p in order}
    assert not set(RESULTS) & set(corpus_pipeline.bpe_encoding(spark, docs, "").columns)


def test_mixing_of_bare_documents(spark):
    bare = spark.createDataFrame([r[:4] for r in ROWS], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.source_mixing(spark, bare, "").columns == bare.columns
