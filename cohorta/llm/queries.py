"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.ann_tree import nearest_neighbours
from cohorta.llm.bpe import encode_and_decode
from cohorta.llm.common import table
from cohorta.llm.exact_topk import exact_top_k
from cohorta.llm.hard_negatives import mine_hard_negatives
from cohorta.llm.lang_id import fit_language_model, identify_language
from cohorta.llm.license_scan import Notice, scan_licenses
from cohorta.llm.line_dedup import dedup_lines
from cohorta.llm.mixing import mix_sources
from cohorta.llm.secret_scan import RULES, scan_secrets
from cohorta.llm.sharding import shard_rows
from cohorta.llm.simhash import near_duplicates
from cohorta.llm.unigram_count import count_tokens, read_pieces
from cohorta.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24

# The base phrases of the licence query, in whole words.
LICENSE_PHRASES = (
    Notice("under the mit license", "mit"),
    Notice("apache license version 2", "apache-2"),
    Notice("cc by nc", "cc-by-nc"),
)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    model = fit_language_model(docs.where(fold != 1).select("text", "lang"))
    asked = docs.select("doc_id", (fold == 1).alias("held_out"), "text")
    return identify_language(asked, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, base=LICENSE_PHRASES).drop("text")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(tokenizer_file("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, whole=True).drop("text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    bits = F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0"))
    return found.select("doc_id", bits.alias("fingerprint"), "component_id")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=20, query_every=20, scale=64.0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_decode(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=False).drop("text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = [r.kind for r in RULES[:3]]
    kinds = F.array(*[F.lit(r.kind) for r in RULES])

    def listed(spans):
        placed = F.transform(
            spans, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]), s["kind"], s["end"])
        )
        return F.array_join(
            F.transform(
                F.array_sort(placed),
                lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    plain = F.filter("secrets", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id",
        *[number(k) for k in base],
        F.sha2(listed(plain), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = shard_rows(sized, ["doc_id", "text_crc32", "size"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, text, list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda s: translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys,
    string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r
  FROM documents
),
many AS (
  SELECT key FROM (SELECT r, unnest(list_distinct(keys)) AS key FROM l) WHERE length(key) >= 1
  GROUP BY key HAVING count(*) >= 10
),
e AS (SELECT r, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(keys, 1) AS i FROM l),
m AS (SELECT e.*, many.key IS NOT NULL AS gone FROM e LEFT JOIN many ON e.key = many.key),
a AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM m GROUP BY r
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM a JOIN l USING (r)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors on the 16 leading components, scaled to unit variance; a deviation beyond a long is null."""
    found = whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64.0, offset=1_000_000)
    return found.withColumn("deviation", F.col("deviation").try_cast("long")).withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with labels moved on by one on every seventh."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5
),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_license_scan, op3_token_count, op4_simhash, op5_exact_topk,
        op6_bpe, op7_secret_scan, op8_mixing, op9_ann, op10_sharding, op11_line_dedup,
        op12_whitening, op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {"op5_exact_topk": OP5_SQL, "op11_line_dedup": OP11_SQL, "op13_hard_negatives": OP13_SQL}
