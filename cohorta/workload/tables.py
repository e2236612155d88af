"""The star schema seen as applicants: Spark frames and the same in SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohorta.functions.scalar import rounded
from cohorta.operators.ranking import rank_table
from cohorta.operators.scoring import Cascade, LinearModel, Split, Term

GRADES = ("math", "scph", "fr", "an", "score_l1")
PLACES = ("academie", "region_naissance", "residence", "etablissement", "centre", "score_dap")


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    """Schema of a stored table, inferred once per session."""
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def applicants(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """One applicant per order, with the asked columns; unused tables are not read."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    df = orders.select(
        F.col("o_orderkey").alias("row_id"),
        "o_custkey",
        F.year("o_orderdate").cast("string").alias("cohort"),
        F.year("o_orderdate").alias("annee_bac"),
        F.when(status == "P", "PASSE").when(status == "O", "AUTORISE").otherwise("NON ADMIS").alias("resultat"),
        F.when(status == "F", "S1").when(status == "O", "S2").otherwise("S3").alias("serie"),
        F.when(F.col("o_orderkey") % 3 == 0, "M").when(F.col("o_orderkey") % 3 == 1, "F").alias("sexe"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Passable")
        .when(F.col("o_orderpriority") == "2-HIGH", "Assez-Bien")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Bien")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Pass")
        .alias("mention"),
        F.floor("o_totalprice").cast("double").alias("moy_gle"),
    )
    if set(columns) & set(GRADES):
        grades = (
            table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("row_id"))
            .agg(
                F.avg("l_quantity").alias("math"),
                F.avg(F.rint(F.col("l_discount") * 100)).alias("scph"),
                F.avg(F.rint(F.col("l_tax") * 100)).alias("fr"),
                F.count(F.lit(1)).cast("double").alias("an"),
                rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("score_l1"),
            )
        )
        df = df.join(grades, "row_id", "left").fillna(0.0, ["math", "scph", "fr", "an"])
    if set(columns) & set(PLACES):
        nation = table(spark, sf_dir, "nation")
        region = table(spark, sf_dir, "region")
        customer = table(spark, sf_dir, "customer")
        homes = (
            customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                F.col("c_custkey").alias("o_custkey"),
                F.col("n_name").alias("academie"),
                F.col("r_name").alias("region_naissance"),
                F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("residence"),
                F.col("c_mktsegment").alias("etablissement"),
                F.concat_ws("/", "n_name", "c_mktsegment").alias("centre"),
                F.col("c_acctbal").alias("score_dap"),
            )
        )
        df = df.join(homes, "o_custkey", "left")
    return df.select(*columns)


APPLICANTS = """
lines AS (
  SELECT l_orderkey, avg(l_quantity) AS math, avg(round_even(l_discount * 100, 0)) AS scph,
         avg(round_even(l_tax * 100, 0)) AS fr, CAST(count(*) AS DOUBLE) AS an,
         round_even(sum(l_extendedprice * (1 - l_discount)) * 10000.0, 0) / 10000.0 AS score_l1
  FROM lineitem GROUP BY l_orderkey
),
applicants AS (
  SELECT o_orderkey AS row_id,
         CAST(year(o_orderdate) AS VARCHAR) AS cohort,
         CAST(year(o_orderdate) AS INTEGER) AS annee_bac,
         CASE o_orderstatus WHEN 'P' THEN 'PASSE' WHEN 'O' THEN 'AUTORISE' ELSE 'NON ADMIS' END AS resultat,
         CASE o_orderstatus WHEN 'F' THEN 'S1' WHEN 'O' THEN 'S2' ELSE 'S3' END AS serie,
         CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sexe,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Passable' WHEN '2-HIGH' THEN 'Assez-Bien'
              WHEN '3-MEDIUM' THEN 'Bien' WHEN '4-NOT SPECIFIED' THEN 'Pass' END AS mention,
         CAST(floor(o_totalprice) AS DOUBLE) AS moy_gle,
         coalesce(math, 0.0) AS math, coalesce(scph, 0.0) AS scph, coalesce(fr, 0.0) AS fr,
         coalesce(an, 0.0) AS an, score_l1,
         n_name AS academie, r_name AS region_naissance,
         CASE WHEN c_acctbal >= 0 THEN c_name END AS residence,
         c_mktsegment AS etablissement, concat_ws('/', n_name, c_mktsegment) AS centre,
         c_acctbal AS score_dap
  FROM orders
  LEFT JOIN lines ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
)"""


# The flagship's model parameters.
TERMS = (Term("moy_gle", 5.0, 250_000.0, 144_000.0), Term("math", 3.0, 25.0, 10.0))
TREES = {
    "admission": Split("moy_gle", 100_000.0, 0, 1),
    "session": Split("math", 20.0, 0, 1),
    "mention": Split("moy_gle", 350_000.0, 0, 1),
}
CASCADE = Cascade(
    TREES,
    {
        "non_admi": LinearModel(20.0, TERMS),
        "deuxieme_session": LinearModel(35.0, TERMS),
        "passable": LinearModel(60.0, TERMS),
        "mention": LinearModel(85.0, TERMS),
    },
)
# Score digits kept, so that both engines compare the same numbers.
DIGITS = 4


def linear_sql(intercept: str, mean: str = "250000.0", scale: str = "144000.0") -> str:
    """The flagship's linear score, operation by operation as the plan does it."""
    x = f"({intercept}) + 5.0 * ((moy_gle - {mean}) / {scale}) + 3.0 * ((math - 25.0) / 10.0)"
    return f"round_even(({x}) * 10000.0, 0) / 10000.0"


ROUTE_SQL = """CASE WHEN moy_gle <= 100000 THEN 'non_admi' WHEN math <= 20 THEN 'deuxieme_session'
     WHEN moy_gle <= 350000 THEN 'passable' ELSE 'mention' END"""

STATUS_SQL = """CASE model_key WHEN 'non_admi' THEN 'NON ADMIS' WHEN 'deuxieme_session' THEN 'DEUXIÈME SESSION'
     WHEN 'passable' THEN 'PASSABLE' WHEN 'mention' THEN 'MENTION SUPÉRIEURE' END"""

INTERCEPT_SQL = """CASE model_key WHEN 'non_admi' THEN 20.0 WHEN 'deuxieme_session' THEN 35.0
     WHEN 'passable' THEN 60.0 ELSE 85.0 END"""

SCORED = f"""{APPLICANTS},
routed AS (SELECT *, {ROUTE_SQL} AS model_key FROM applicants),
scored AS (
  SELECT *, {STATUS_SQL} AS status, {linear_sql(INTERCEPT_SQL)} AS score FROM routed
)"""


def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historic scores, one per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.rint("c_acctbal") / F.lit(100.0)).alias("score")
    )


def rank_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score to rank table from the historic scores."""
    return rank_table(rank_scores(spark, sf_dir), "score", "id")


RANK_TABLE = """
ranks AS (
  SELECT DISTINCT score AS table_score, rank() OVER (ORDER BY score DESC) AS rank
  FROM (SELECT round_even(c_acctbal, 0) / 100.0 AS score FROM customer)
)"""
