"""A training corpus from raw documents: language, near copies, secrets, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohorta.llm.bpe import encode_and_decode
from cohorta.llm.common import table, unused_name
from cohorta.llm.lang_id import fit_language_model, fit_language_range, keep_known_languages
from cohorta.llm.mixing import RESULTS, mix_sources
from cohorta.llm.queries import tokenizer_file
from cohorta.llm.secret_scan import redact_secrets
from cohorta.llm.simhash import keep_one
from cohorta.scratch import materialize

# What a document's place in the mixture depends on.
PLACED_BY = ("doc_id", "lang", "source", "text")


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out texts without a letter or unlike all learned languages; without a labelled row all others stay."""
    model = fit_language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = keep_known_languages(docs, model, fit_language_range(docs, model)).where("in_language")
    return _columns(known, docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return keep_one(docs, shingle=3, max_bits=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars`` follows the text where it changed."""
    safe = redact_secrets(docs)
    changed = ~F.col("redacted").eqNullSafe(F.col("text"))
    if "n_chars" in docs.columns:
        length = F.length("redacted").cast(docs.schema["n_chars"].dataType)
        safe = safe.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return _columns(safe.withColumn("text", F.col("redacted")), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the order of the mixture, within and across the written files.

    Files are not read again in the order they were written in, so each document also
    carries its place: ``source`` becomes a struct of the source and ``block``, ``release``,
    ``deadline``, ``slot`` and ``position``. The places follow from id, language, source and text alone.
    """
    rest, others = unused_name(docs, "rest"), [c for c in docs.columns if c not in PLACED_BY]
    # Inside a struct the other columns take no part in the order, whatever they are called.
    packed = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(rest)] if others else []
    mixed = mix_sources(docs.select(*PLACED_BY, *packed)).orderBy("position")
    placed = F.struct("source", *RESULTS).alias("source")
    unpacked = [f"{rest}.*"] if others else []
    return _columns(mixed.select(*[placed if c == "source" else c for c in PLACED_BY], *unpacked), docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with digests of the ids and of the decoded text, and its place in the mixture.

    The place is the one that ``source_mixing`` gave it, as columns; documents that were not mixed have none.
    """
    mixed = isinstance(docs.schema["source"].dataType, StructType)
    kept = docs.select("doc_id", "lang", "source.*" if mixed else "source", "text")
    return encode_and_decode(kept, tokenizer_file("word_bpe_49k.json")).drop("text")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

# Hashes, automata and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
