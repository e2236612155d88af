"""Scan and feature preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta import schema
from cohorta.functions.scalar import as_column, number_or_zero, parse_number, rounded
from cohorta.operators import features as P
from cohorta.operators import group_state as G
from cohorta.scratch import materialize, scratch_path
from cohorta.sources.tables import load_cohort, read_csv_table, select_fields
from cohorta.workload.registry import query
from cohorta.workload.tables import APPLICANTS, applicants, table


def flags_sql(flags, source_names=None) -> str:
    parts = []
    for source, columns in flags.items():
        for name, value in columns.items():
            parts.append(f"CASE WHEN {source} = '{value}' THEN 1 ELSE 0 END AS {name}")
    return ", ".join(parts)


@query("SELECT o_orderkey AS row_id, o_orderstatus AS serie, o_totalprice AS moy_gle FROM orders")
def scan_project(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return select_fields(orders, {"o_orderkey": "row_id", "o_orderstatus": "serie", "o_totalprice": "moy_gle"})


@query(f"""WITH {APPLICANTS}
SELECT row_id, serie, sexe, mention, moy_gle, CAST(math AS DOUBLE) AS math, annee_bac FROM applicants""")
def scan_csv_cohort(spark, sf_dir):
    """Applicants written as a file in the external layout, and read back."""
    names = {"serie": "Série", "sexe": "Sexe", "mention": "Mention", "moy_gle": "Moy. Gle",
             "math": "MATH", "annee_bac": "Année BAC"}
    path = scratch_path(spark, "cohort-csv")
    df = applicants(spark, sf_dir, ["row_id", *names])
    df.withColumnsRenamed(names).write.option("header", True).csv(path)
    back = read_csv_table(spark, path)
    return back.withColumn("row_id", F.col("row_id").cast("long"))


@query(f"""WITH {APPLICANTS},
filled AS (SELECT * REPLACE (coalesce(residence, '0') AS residence, coalesce(academie, '0') AS academie,
                             CASE WHEN row_id % 4 = 1 THEN 0 ELSE annee_bac END AS annee_bac) FROM applicants)
SELECT row_id, annee_bac, moy_gle, {flags_sql(schema.COHORT_FLAGS)},
       avg(moy_gle) OVER (PARTITION BY academie) AS academie_perf,
       avg(moy_gle) OVER (PARTITION BY residence) AS residence_perf
FROM filled""")
def load_cohort_csv(spark, sf_dir):
    """A cohort in files whose columns stand in two orders, some years no whole numbers: read and prepared."""
    names = {"serie": "Série", "sexe": "Sexe", "mention": "Mention", "moy_gle": "Moy. Gle", "annee_bac": "Année BAC",
             "academie": "Académie de l'Ets. Prov.", "residence": "Résidence"}
    path = scratch_path(spark, "cohort-csv")
    df = applicants(spark, sf_dir, ["row_id", *names])
    year = F.when(F.col("row_id") % 4 == 1, F.col("annee_bac") + 0.5).otherwise(F.col("annee_bac"))
    df = df.withColumn("annee_bac", year).withColumnsRenamed(names)
    for rest, columns in enumerate((df.columns, df.columns[::-1])):
        part = df.where(F.col("row_id") % 2 == rest).select(*map(as_column, columns))
        part.write.mode("append").option("header", True).csv(path)
    return load_cohort(spark, path).withColumn("row_id", F.col("row_id").cast("long"))


@query("""SELECT c_custkey AS row_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sexe,
c_acctbal AS moy_gle, c_name AS residence, c_mktsegment AS etablissement FROM customer""")
def rename_fields(spark, sf_dir):
    """Applicant records, field names translated."""
    records = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("Sexe"),
        F.col("c_acctbal").alias("Moy_Gle"),
        F.col("c_name").alias("Résidence"),
        F.col("c_mktsegment").alias("Ets_de_provenance"),
    )
    return P.rename_fields(records)


@query(f"WITH {APPLICANTS} SELECT row_id, moy_gle, {flags_sql(schema.TREE_FLAGS)} FROM applicants")
def onehot_fixed(spark, sf_dir):
    return P.one_hot(applicants(spark, sf_dir, ["row_id", "moy_gle", "sexe", "serie", "mention"]))


@query(f"""WITH {APPLICANTS}, spelt AS (SELECT * REPLACE (CASE mention WHEN 'Pass' THEN 'Passable' ELSE mention END AS mention) FROM applicants)
SELECT row_id, moy_gle, {flags_sql(schema.TREE_FLAGS)} FROM spelt""")
def onehot_aliases(spark, sf_dir):
    """Flags of mentions in the spelling of the applicant files, too."""
    df = applicants(spark, sf_dir, ["row_id", "moy_gle", "sexe", "serie", "mention"])
    return P.one_hot(df, aliases=schema.MENTION_ALIASES)


@query(f"WITH {APPLICANTS} SELECT row_id, mention, {flags_sql(schema.COHORT_FLAGS)} FROM applicants")
def onehot_cohort(spark, sf_dir):
    df = applicants(spark, sf_dir, ["row_id", "sexe", "serie", "mention"])
    return P.one_hot(df, schema.COHORT_FLAGS)


@query(f"""WITH {APPLICANTS} SELECT row_id, CASE WHEN serie = 'S1' THEN 1 ELSE 0 END AS serie_s1,
CASE WHEN serie = 'S1' THEN 1 ELSE 0 END AS s1 FROM applicants""")
def flag_fallback(spark, sf_dir):
    """The flag of a frame that no longer has the series, only its one-hot form."""
    df = P.one_hot(applicants(spark, sf_dir, ["row_id", "serie"]), {"serie": {"serie_s1": "S1"}})
    return P.flag_with_fallback(df)


@query(f"""WITH {APPLICANTS} SELECT row_id, coalesce(residence, '0') AS residence, coalesce(sexe, '0') AS sexe,
coalesce(score_l1, 0.0) AS score_l1 FROM applicants""")
def fill_nulls(spark, sf_dir):
    return P.fill_nulls(applicants(spark, sf_dir, ["row_id", "residence", "sexe", "score_l1"]))


@query("""SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS padded, 0.0::DOUBLE AS brand,
CAST(substring(p_brand, 7) AS DOUBLE) AS brand_number FROM part""")
def coerce_numeric(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("padded"),
        F.col("p_brand").alias("brand"),
        F.substring("p_brand", 7, 10).alias("brand_number"),
    )
    names = ["padded", "brand", "brand_number"]
    return part.select("row_id", *[number_or_zero(part, n).alias(n) for n in names])


@query("""SELECT event_id AS row_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
try_cast(event_type AS DOUBLE) AS kind FROM events""")
def clean_numeric_text(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("row_id"),
        parse_number(F.concat(F.lit("  "), F.get_json_object("props", "$.k"))).alias("k"),
        parse_number("event_type").alias("kind"),
    )


@query(f"""WITH {APPLICANTS} SELECT row_id, math, 0.0::DOUBLE AS svt, moy_gle, 0.0::DOUBLE AS sexe FROM applicants""")
def conform_features(spark, sf_dir):
    """Ordered feature list: an absent column and unparsable text give 0."""
    df = applicants(spark, sf_dir, ["row_id", "moy_gle", "math", "sexe"])
    return P.conform(df, ["math", "svt", "moy_gle", "sexe"], keep=["row_id"])


@query(f"WITH {APPLICANTS} SELECT row_id, moy_gle, math FROM applicants")
def strict_features(spark, sf_dir):
    df = applicants(spark, sf_dir, ["row_id", "moy_gle", "math"])
    return P.require_columns(df, ["moy_gle", "math"])


CODES = """
codes AS (
  SELECT 'academie' AS column_name, label, dense_rank() OVER (ORDER BY label) - 1 AS code
  FROM (SELECT DISTINCT coalesce(academie, 'nan') AS label FROM applicants)
  UNION ALL SELECT 'residence', label, dense_rank() OVER (ORDER BY label) - 1
  FROM (SELECT DISTINCT coalesce(residence, 'nan') AS label FROM applicants)
  UNION ALL SELECT 'etablissement', label, dense_rank() OVER (ORDER BY label) - 1
  FROM (SELECT DISTINCT coalesce(etablissement, 'nan') AS label FROM applicants)
  UNION ALL SELECT 'centre', label, dense_rank() OVER (ORDER BY label) - 1
  FROM (SELECT DISTINCT coalesce(centre, 'nan') AS label FROM applicants)
  UNION ALL SELECT 'region_naissance', label, dense_rank() OVER (ORDER BY label) - 1
  FROM (SELECT DISTINCT coalesce(region_naissance, 'nan') AS label FROM applicants)
)"""


def code_sql(column: str) -> str:
    return f"""(SELECT code FROM codes WHERE column_name = '{column}' AND label = coalesce(a.{column}, 'nan'))"""


@query(f"""WITH {APPLICANTS}, {CODES}
SELECT row_id, {", ".join(f"CAST({code_sql(c)} AS BIGINT) AS {c}" for c in ("residence", "academie", "etablissement"))}
FROM applicants a""")
def label_encode(spark, sf_dir):
    names = ["residence", "academie", "etablissement"]
    df = applicants(spark, sf_dir, ["row_id", *names])
    return P.apply_label_codes(df, P.label_codes(df, names), names).select("row_id", *names)


@query(f"""WITH {APPLICANTS} SELECT residence, avg(moy_gle) AS mean FROM applicants
WHERE residence IS NOT NULL GROUP BY residence""")
def group_mean(spark, sf_dir):
    df = applicants(spark, sf_dir, ["residence", "moy_gle"])
    return P.group_mean(df, ["residence"], "moy_gle", "mean")


def _target_mean_sql(key: str, out: str) -> str:
    return f"""WITH {APPLICANTS}, means AS (SELECT {key} AS k, avg(moy_gle) AS m FROM applicants GROUP BY 1)
SELECT row_id, {key}, m AS {out} FROM applicants LEFT JOIN means ON {key} = k"""


@query(_target_mean_sql("academie", "academie_perf"))
def target_mean_academy(spark, sf_dir):
    df = applicants(spark, sf_dir, ["row_id", "academie", "moy_gle"])
    return P.target_mean(df, ["academie"], "moy_gle", "academie_perf").select("row_id", "academie", "academie_perf")


@query(_target_mean_sql("residence", "residence_perf"))
def target_mean_residence(spark, sf_dir):
    df = applicants(spark, sf_dir, ["row_id", "residence", "moy_gle"])
    return P.target_mean(df, ["residence"], "moy_gle", "residence_perf").select("row_id", "residence", "residence_perf")


@query(f"""WITH {APPLICANTS},
filled AS (SELECT * REPLACE (coalesce(residence, '0') AS residence, coalesce(academie, '0') AS academie,
                             coalesce(score_l1, 0.0) AS score_l1) FROM applicants)
SELECT row_id, cohort, moy_gle, score_l1, resultat, {flags_sql(schema.COHORT_FLAGS)},
       avg(moy_gle) OVER (PARTITION BY cohort, academie) AS academie_perf,
       avg(moy_gle) OVER (PARTITION BY cohort, residence) AS residence_perf
FROM filled""")
def cohort_prep(spark, sf_dir):
    df = applicants(spark, sf_dir, ["row_id", "cohort", "moy_gle", "score_l1", "resultat", "serie", "sexe",
                                    "mention", "academie", "residence"])
    return P.cohort_prep(df, cohort="cohort")


_TREE_INPUTS = {
    "annee_bac": "annee_bac", "math": "math", "scph": "scph", "fr": "fr", "an": "an", "moy_gle": "moy_gle",
    "academie_perf": "avg(moy_gle) OVER (PARTITION BY coalesce(academie, 'nan'))",
}
_FLAG_OF = {n: (s, v) for s, cols in schema.TREE_FLAGS.items() for n, v in cols.items()}


def _tree_sql() -> str:
    columns = []
    for name in schema.TREE_FEATURES:
        if name in _FLAG_OF:
            source, value = _FLAG_OF[name]
            text = f"CASE WHEN {source} = '{value}' THEN 1 ELSE 0 END"
        elif name in schema.LABEL_COLUMNS:
            text = code_sql(name)
        else:
            text = _TREE_INPUTS.get(name, "0")
        columns.append(f"CAST({text} AS DOUBLE) AS {name}")
    return f"WITH {APPLICANTS}, {CODES} SELECT row_id, {', '.join(columns)} FROM applicants a"


@query(_tree_sql())
def tree_features(spark, sf_dir):
    df = applicants(spark, sf_dir, [
        "row_id", "annee_bac", "math", "scph", "fr", "an", "moy_gle", "sexe", "serie", "mention",
        "academie", "region_naissance", "residence", "etablissement", "centre",
    ])
    return P.tree_features(df, P.fit_tree_stats(df), keep=["row_id"])


@query(f"""WITH {APPLICANTS},
a AS (SELECT residence AS k, avg(moy_gle) AS m FROM applicants GROUP BY 1),
b AS (SELECT academie AS k, avg(moy_gle) AS m FROM applicants GROUP BY 1)
SELECT row_id, CAST(CASE WHEN serie = 'S1' THEN 1 ELSE 0 END AS DOUBLE) AS s1, math, moy_gle,
       coalesce(b.m, 0.0) AS academie_perf, coalesce(a.m, 0.0) AS residence_perf, 0.0::DOUBLE AS svt
FROM applicants LEFT JOIN a ON residence = a.k LEFT JOIN b ON academie = b.k""")
def linear_features(spark, sf_dir):
    df = applicants(spark, sf_dir, ["row_id", "serie", "math", "moy_gle", "academie", "residence"])
    stats = P.fit_feature_stats(df, labels=())
    wanted = ["s1", "math", "moy_gle", "academie_perf", "residence_perf", "svt"]
    return P.linear_features(df, wanted, stats, keep=["row_id"])


@query(f'WITH {APPLICANTS} SELECT row_id, score_dap, score_dap AS "Score_Predit" FROM applicants')
def baseline_predictor(spark, sf_dir):
    return P.baseline_prediction(applicants(spark, sf_dir, ["row_id", "score_dap"]))


@query(f"""WITH {APPLICANTS} SELECT tag AS cohort, row_id, moy_gle FROM applicants
JOIN (VALUES ('early', 1995, 1998), ('late', 1997, 2001)) AS spans(tag, first_year, last_year)
ON annee_bac BETWEEN first_year AND last_year""")
def cohort_union(spark, sf_dir):
    """Two overlapping cohorts stacked; the shared rows stay twice."""
    df = applicants(spark, sf_dir, ["row_id", "moy_gle", "annee_bac"])
    spans = {"early": (1995, 1998), "late": (1997, 2001)}
    parts = {tag: df.where(F.col("annee_bac").between(*span)) for tag, span in spans.items()}
    return P.stack_cohorts(parts).select("cohort", "row_id", as_column("moy_gle"))


@query(f"""WITH {APPLICANTS} SELECT 'academie_perf' AS grouping, academie AS name, round_even(avg(moy_gle) * 1e4, 0) / 1e4 AS mean,
CAST(count(*) AS BIGINT) AS n FROM applicants WHERE academie IS NOT NULL GROUP BY academie
UNION ALL SELECT 'residence_perf', residence, round_even(avg(moy_gle) * 1e4, 0) / 1e4, CAST(count(*) AS BIGINT)
FROM applicants WHERE residence IS NOT NULL GROUP BY residence""")
def group_state_merge(spark, sf_dir):
    """Means of all cohorts from the state of the old ones and that of the new ones."""
    df = materialize(applicants(spark, sf_dir, ["cohort", "academie", "residence", "moy_gle"]), "applicants")
    groupings = {"academie_perf": ["academie"], "residence_perf": ["residence"]}
    old, new = (G.group_state(df.where(c), groupings, "moy_gle") for c in ("cohort < '1997'", "cohort >= '1997'"))
    merged = materialize(G.merge_states(materialize(old, "old-state"), new), "state")
    mean = rounded(F.col("total") / F.col("n"), 4).alias("mean")
    return merged.select("grouping", F.coalesce("academie", "residence").alias("name"), mean, "n")
