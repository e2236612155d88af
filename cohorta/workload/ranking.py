"""Ranking, as-of and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.operators import ranking as R
from cohorta.operators.asof import asof_lookup
from cohorta.scratch import materialize
from cohorta.workload.registry import query
from cohorta.workload.tables import APPLICANTS, applicants, table

# Part sizes are whole numbers below 51: long runs of equal scores in every brand.
_PARTS = "SELECT p_partkey AS row_id, p_brand AS cohort, p_size AS score FROM part"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("cohort"), F.col("p_size").alias("score")
    )


def _rank(spark, sf_dir, method):
    return R.add_ranks(_parts(spark, sf_dir), "score", "row_id", by=["cohort"], methods=(method,))


@query(f"""SELECT row_id, cohort, score, rank() OVER w + (count(*) OVER (PARTITION BY cohort, score) - 1) / 2.0::DOUBLE
AS rank_average FROM ({_PARTS}) WINDOW w AS (PARTITION BY cohort ORDER BY score DESC)""")
def rank_average(spark, sf_dir):
    return _rank(spark, sf_dir, "average")


@query(f"""SELECT row_id, cohort, score, rank() OVER (PARTITION BY cohort ORDER BY score DESC) AS rank_min
FROM ({_PARTS})""")
def rank_min(spark, sf_dir):
    return _rank(spark, sf_dir, "min")


@query(f"""SELECT row_id, cohort, score, row_number() OVER (PARTITION BY cohort ORDER BY score DESC, row_id)
AS rank_first FROM ({_PARTS})""")
def rank_first(spark, sf_dir):
    return _rank(spark, sf_dir, "first")


@query(f"""SELECT row_id, cohort, score, rank() OVER (PARTITION BY cohort ORDER BY score DESC)
+ count(*) OVER (PARTITION BY cohort, score) - 1 AS rank_max FROM ({_PARTS})""")
def rank_max(spark, sf_dir):
    return _rank(spark, sf_dir, "max")


@query(f"""SELECT row_id, cohort, score, dense_rank() OVER (PARTITION BY cohort ORDER BY score DESC) AS rank_dense
FROM ({_PARTS})""")
def rank_dense(spark, sf_dir):
    return _rank(spark, sf_dir, "dense")


@query(f"""WITH {APPLICANTS} SELECT row_id, cohort, score_l1,
CASE WHEN score_l1 IS NOT NULL THEN rank() OVER (PARTITION BY cohort, score_l1 IS NULL ORDER BY score_l1 DESC)
 + (count(*) OVER (PARTITION BY cohort, score_l1) - 1) / 2.0::DOUBLE END AS rank_average FROM applicants""")
def rank_nulls(spark, sf_dir):
    """Applicants without a score keep a null rank."""
    # Ranking reads its input more than once: write the joined scores first.
    df = materialize(applicants(spark, sf_dir, ["row_id", "cohort", "score_l1"]), "scores")
    return R.add_ranks(df, "score_l1", "row_id", by=["cohort"], methods=("average",))


@query("SELECT o_totalprice AS score, rank() OVER (ORDER BY o_totalprice DESC) AS rank FROM orders")
def rank_table_global(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return R.rank_table(orders, "o_totalprice", "o_orderkey")


_ASOF = """WITH ranks AS (
  SELECT DISTINCT c_acctbal AS table_score, rank() OVER (ORDER BY c_acctbal DESC) AS rank FROM customer
), probes AS ({probes})
SELECT row_id, score, coalesce(rank, 0) AS rank FROM probes
ASOF LEFT JOIN ranks ON probes.score >= ranks.table_score"""


def _asof(spark, sf_dir, probes, **options):
    scores = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    ranks = R.rank_table(scores, "c_acctbal", "c_custkey")
    return asof_lookup(probes, ranks, "score", "score", "rank", "rank", "row_id", **options)


@query(_ASOF.format(probes="SELECT s_suppkey AS row_id, s_acctbal AS score FROM supplier"))
def asof_rank_lookup(spark, sf_dir):
    probes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("score")
    )
    return _asof(spark, sf_dir, probes)


@query(_ASOF.format(probes="SELECT o_orderkey AS row_id, o_totalprice / 50.0 AS score FROM orders"))
def asof_rank_lookup_sliced(spark, sf_dir):
    """The same lookup the way a table too large to broadcast takes."""
    probes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / F.lit(50.0)).alias("score")
    )
    return _asof(spark, sf_dir, probes, small_rows=0)


@query(f"""WITH {APPLICANTS} SELECT row_id, cohort, score_l1 FROM applicants WHERE score_l1 IS NULL""")
def null_score_rows(spark, sf_dir):
    return R.null_scores(applicants(spark, sf_dir, ["row_id", "cohort", "score_l1"]), ["score_l1"])


@query("""SELECT o_orderkey AS row_id, o_totalprice AS score,
row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders""")
def sorted_by_score(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("score")
    )
    return R.sort_by_score(df, "score", "row_id", index="position")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier ORDER BY s_suppkey LIMIT 25 OFFSET 10")
def paginate(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.paginate(df, "id", skip=10, limit=25)


@query("""SELECT id, rank() OVER (ORDER BY score DESC) AS rank_min, dense_rank() OVER (ORDER BY score DESC) AS rank_dense
FROM (SELECT c_custkey AS id, round_even(c_acctbal / 2000.0, 0) * (c_custkey % 2) + 0.0 AS score FROM customer)""")
def rank_zero_ties(spark, sf_dir):
    """Half of the scores are zero, of either sign."""
    rounded = F.rint(F.col("c_acctbal") / F.lit(2000.0))
    score = F.when(F.col("c_custkey") % 2 == 0, rounded * F.lit(-0.0)).otherwise(rounded)
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), score.alias("score"))
    ranked = R.add_ranks(df, "score", "id", methods=("min", "dense"))
    return ranked.select("id", "rank_min", "rank_dense")


@query("""SELECT l_orderkey, l_linenumber, place FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) - 12001 AS place FROM lineitem)
WHERE place >= 0 AND place < 500""")
def paginate_deep(spark, sf_dir):
    """A page beyond the top-k depth, with each row's place on it."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    page = R.paginate(df, "line", skip=12_000, limit=500)
    return R.number_rows(page, ["line"], "place", start=0).select("l_orderkey", "l_linenumber", "place")


def _ranks_sql(score: str, rows: str) -> str:
    """All tie rules over (row_id, cohort, score), written with plain windows."""
    return f"""SELECT row_id, cohort, {score} AS score, rank() OVER w + (count(*) OVER (PARTITION BY cohort, score) - 1) / 2.0::DOUBLE
AS rank_average, row_number() OVER (PARTITION BY cohort ORDER BY score DESC, row_id) AS rank_first, rank() OVER w AS rank_min,
rank() OVER w + count(*) OVER (PARTITION BY cohort, score) - 1 AS rank_max, dense_rank() OVER w AS rank_dense
FROM ({rows}) WINDOW w AS (PARTITION BY cohort ORDER BY score DESC)"""


@query(_ranks_sql("CAST(score AS VARCHAR)", "SELECT p_partkey AS row_id, p_brand AS cohort, 9007199254740992 + p_size AS score FROM part"))
def rank_long(spark, sf_dir):
    """Whole numbers from 2 ** 53, of which a double holds every second only."""
    df = _parts(spark, sf_dir).withColumn("score", F.col("score").cast("long") + F.lit(2**53))
    ranked = R.add_ranks(df, "score", "row_id", by=["cohort"], methods=R.TIE_METHODS)
    return ranked.withColumn("score", F.col("score").cast("string"))


@query(_ranks_sql("CAST(score AS VARCHAR)", """SELECT c_custkey AS row_id, c_mktsegment AS cohort,
CAST(round_even(c_acctbal / 100, 0) AS DECIMAL(38, 2)) + CAST('123456789012345678901234.00' AS DECIMAL(38, 2)) AS score
FROM customer"""))
def rank_decimal(spark, sf_dir):
    """Decimals of 24 digits that differ in the last ones."""
    whole = F.rint(F.col("c_acctbal") / F.lit(100.0)).cast("decimal(30,2)")
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("cohort"),
        (whole + F.lit("123456789012345678901234.00").cast("decimal(36,2)")).cast("decimal(38,2)").alias("score"),
    )
    ranked = R.add_ranks(df, "score", "row_id", by=["cohort"], methods=R.TIE_METHODS)
    return ranked.withColumn("score", F.col("score").cast("string"))


@query(_ranks_sql("strftime(score, '%Y-%m-%d')", "SELECT o_orderkey AS row_id, o_orderstatus AS cohort, CAST(o_orderdate AS DATE) AS score FROM orders"))
def rank_date(spark, sf_dir):
    """The latest order first."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("cohort"), F.col("o_orderdate").cast("date").alias("score")
    )
    ranked = R.add_ranks(df, "score", "row_id", by=["cohort"], methods=R.TIE_METHODS)
    return ranked.withColumn("score", F.date_format("score", "yyyy-MM-dd"))
