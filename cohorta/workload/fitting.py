"""Queries on fitting, and on trees too large for conditionals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.operators import scoring as M
from cohorta.operators.trees import LEAF, TreeArrays, score_tree_table
from cohorta.plans.fit_groups import fit_by_group, fit_cohort_models, group_moments
from cohorta.plans.fit_trees import fit_tree_exact
from cohorta.scratch import materialize
from cohorta.sources.models import trees_from_table
from cohorta.sources.tables import TREE_TABLE_SCHEMA
from cohorta.workload.registry import query
from cohorta.workload.tables import APPLICANTS, applicants

# A complete tree of this depth has 8,191 nodes; its levels ask two features in turn.
DEPTH = 12
_REACH = {"moy_gle": 600_000.0, "math": 50.0}


def _halving_tree(spark):
    """Node i of level l halves the reach of the level's feature at its place among the level's nodes."""
    nodes = spark.range(2 ** (DEPTH + 1) - 1).withColumn("node", F.col("id").cast("int"))
    level = F.floor(F.log2(F.col("node") + 1)).cast("int")
    nodes = nodes.withColumn("level", level).withColumn("place", F.col("node") + 1 - F.pow(F.lit(2), "level"))
    inner = F.col("level") < DEPTH
    name = F.when(F.col("level") % 2 == 0, "moy_gle").otherwise("math")
    reach = F.when(F.col("level") % 2 == 0, _REACH["moy_gle"]).otherwise(_REACH["math"])
    return nodes.select(
        F.lit("halving").alias("model_key"),
        "node",
        F.when(inner, name).alias("feature"),
        F.when(inner, reach * (2 * F.col("place") + 1) / F.pow(F.lit(2), F.col("level") + 1)).alias("threshold"),
        F.when(inner, 2 * F.col("node") + 1).alias("left"),
        F.when(inner, 2 * F.col("node") + 2).alias("right"),
        F.when(~inner, F.col("node")).alias("prediction"),
    )


_WALK = f"""WITH RECURSIVE {APPLICANTS}, walk AS (
  SELECT row_id, moy_gle, math, 0 AS node, 0 AS level FROM applicants
  UNION ALL
  SELECT row_id, moy_gle, math, 2 * node + CASE WHEN
    CASE level % 2 WHEN 0 THEN moy_gle ELSE math END <=
    CASE level % 2 WHEN 0 THEN 600000.0 ELSE 50.0 END * (2 * (node + 1 - (1 << level)) + 1) / (1 << (level + 1))::DOUBLE
    THEN 1 ELSE 2 END, level + 1
  FROM walk WHERE level < {DEPTH}
) SELECT row_id, CAST(node AS INTEGER) AS leaf FROM walk WHERE level = {DEPTH}"""


@query(_WALK)
def tree_score_large(spark, sf_dir):
    """A stored tree of 8,191 nodes, read back and scored in one projection."""
    stored = materialize(_halving_tree(spark), "trees")
    tree = trees_from_table(stored)["halving"]
    df = applicants(spark, sf_dir, ["row_id", "moy_gle", "math"])
    return df.select("row_id", M.tree_decision(tree).alias("leaf"))


@query(f"""WITH {APPLICANTS}, means AS (
  SELECT cohort, round_even(avg(moy_gle), 0) AS g, round_even(avg(math), 0) AS q FROM applicants GROUP BY cohort
) SELECT row_id, cohort, CASE WHEN moy_gle <= g THEN 0 WHEN math <= q THEN 1 ELSE 2 END AS answer
FROM applicants JOIN means USING (cohort)""")
def tree_forest_score(spark, sf_dir):
    """One tree per cohort, learned and kept as a table, walked by joins."""
    df = materialize(applicants(spark, sf_dir, ["row_id", "cohort", "moy_gle", "math"]), "applicants")
    means = df.groupBy("cohort").agg(F.rint(F.avg("moy_gle")).alias("g"), F.rint(F.avg("math")).alias("q"))
    leaf = [F.lit(None).cast(t) for t in ("string", "double", "int", "int")]
    nodes = [
        (0, F.lit("moy_gle"), F.col("g"), F.lit(1), F.lit(2), F.lit(None)),
        (1, *leaf, F.lit(0)),
        (2, F.lit("math"), F.col("q"), F.lit(3), F.lit(4), F.lit(None)),
        (3, *leaf, F.lit(1)),
        (4, *leaf, F.lit(2)),
    ]
    names = ("node", "feature", "threshold", "left", "right", "prediction")
    kinds = ("int", "string", "double", "int", "int", "int")
    rows = [F.struct(*[(c if n else F.lit(c)).cast(k).alias(m) for n, (c, k, m) in enumerate(zip(r, kinds, names))]) for r in nodes]
    trees = means.select(F.col("cohort").alias("model_key"), F.inline(F.array(*rows)))
    scored = score_tree_table(df, trees, "", ["moy_gle", "math"], "answer", key="cohort")
    return scored.select("row_id", "cohort", "answer")


@query(f"""WITH {APPLICANTS}, t AS (SELECT * FROM applicants WHERE score_l1 IS NOT NULL)
SELECT cohort, CAST(count(*) AS BIGINT) AS n, round_even(avg(score_l1) * 100, 0) / 100 AS target_mean,
round_even(avg(moy_gle) * 1e4, 0) / 1e4 AS mean_0, round_even(avg(math) * 1e6, 0) / 1e6 AS mean_1,
round_even(stddev_pop(moy_gle) * 1e4, 0) / 1e4 AS scale_0, round_even(stddev_pop(math) * 1e6, 0) / 1e6 AS scale_1,
round_even(corr(moy_gle, math) * 1e8, 0) / 1e8 AS correlation,
round_even(covar_pop(moy_gle, score_l1) / stddev_pop(moy_gle) * 100, 0) / 100 AS with_target_0,
round_even(covar_pop(math, score_l1) / stddev_pop(math) * 100, 0) / 100 AS with_target_1 FROM t GROUP BY cohort""")
def fit_moments(spark, sf_dir):
    """What a linear fit of each cohort needs, from one pass over the applicants."""
    df = applicants(spark, sf_dir, ["cohort", "moy_gle", "math", "score_l1"])
    found = group_moments(df, ["moy_gle", "math"], "score_l1", ["cohort"])
    return found.select(
        "cohort", "n", M.rounded(F.col("target_mean"), 2).alias("target_mean"),
        M.rounded(F.col("means")[0], 4).alias("mean_0"), M.rounded(F.col("means")[1], 6).alias("mean_1"),
        M.rounded(F.col("scales")[0], 4).alias("scale_0"), M.rounded(F.col("scales")[1], 6).alias("scale_1"),
        M.rounded(F.col("covariances")[0][1], 8).alias("correlation"),
        M.rounded(F.col("with_target")[0], 2).alias("with_target_0"), M.rounded(F.col("with_target")[1], 2).alias("with_target_1"),
    )


_LABELS = """CASE WHEN resultat = 'NON ADMIS' THEN 'non_admi' WHEN resultat <> 'PASSE' THEN 'deuxieme_session'
  WHEN score_l1 < 150000 THEN 'passable' WHEN score_l1 >= 150000 THEN 'mention' END"""
_PENALTY = 500.0


def _labels():
    return {
        "admission": (F.col("resultat") != "NON ADMIS").cast("int"),
        "session": (F.col("resultat") == "PASSE").cast("int"),
        "mention": (F.col("score_l1") >= 150_000).cast("int"),
    }


def _shown(models, keys):
    return models.select(
        *keys, "ord", "feature", M.rounded(F.col("coef"), 2).alias("coef"), M.rounded(F.col("mean"), 4).alias("mean"),
        M.rounded(F.col("scale"), 4).alias("scale"), M.rounded(F.col("intercept"), 2).alias("intercept"),
    )


@query(f"""WITH {APPLICANTS}, t AS (SELECT cohort, {_LABELS} AS model_key, moy_gle, score_l1 FROM applicants WHERE score_l1 IS NOT NULL),
s AS (
  SELECT cohort, model_key, avg(moy_gle) AS mean, CASE WHEN stddev_pop(moy_gle) > 0 THEN stddev_pop(moy_gle) ELSE 1 END AS scale,
    avg(score_l1) AS intercept, covar_pop(moy_gle, score_l1) AS c FROM t GROUP BY cohort, model_key
)
SELECT cohort, model_key, 0 AS ord, 'moy_gle' AS feature,
round_even(sign(c) * greatest(abs(c / scale) - {_PENALTY}, 0) * 100, 0) / 100 AS coef, round_even(mean * 1e4, 0) / 1e4 AS mean,
round_even(scale * 1e4, 0) / 1e4 AS scale, round_even(intercept * 100, 0) / 100 AS intercept FROM s WHERE model_key IS NOT NULL""")
def fit_by_cohort(spark, sf_dir):
    """A lasso per cohort and route; with one feature it has a closed form."""
    df = applicants(spark, sf_dir, ["cohort", "resultat", "moy_gle", "score_l1"])
    return _shown(fit_cohort_models(df, ["moy_gle"], _labels(), "score_l1", penalty=_PENALTY), ["cohort", "model_key"])


_LEAST_SQUARES = f"""{APPLICANTS}, s AS (
  SELECT cohort, avg(moy_gle) AS m0, avg(math) AS m1, stddev_pop(moy_gle) AS s0, stddev_pop(math) AS s1, avg(score_l1) AS b,
    corr(moy_gle, math) AS r, covar_pop(moy_gle, score_l1) / stddev_pop(moy_gle) AS y0, covar_pop(math, score_l1) / stddev_pop(math) AS y1
  FROM applicants WHERE score_l1 IS NOT NULL GROUP BY cohort
), f AS (SELECT *, (y0 - r * y1) / (1 - r * r) AS c0, (y1 - r * y0) / (1 - r * r) AS c1 FROM s)"""


@query(f"""WITH {_LEAST_SQUARES}, p AS (
  SELECT cohort, 0 AS ord, 'moy_gle' AS feature, c0 AS coef, m0 AS mean, s0 AS scale, b FROM f
  UNION ALL SELECT cohort, 1, 'math', c1, m1, s1, b FROM f
) SELECT cohort, ord, feature, round_even(coef * 100, 0) / 100 AS coef, round_even(mean * 1e4, 0) / 1e4 AS mean,
round_even(scale * 1e4, 0) / 1e4 AS scale, round_even(b * 100, 0) / 100 AS intercept FROM p""")
def fit_least_squares(spark, sf_dir):
    """Without a penalty the fit of two features solves the normal equations."""
    df = applicants(spark, sf_dir, ["cohort", "moy_gle", "math", "score_l1"])
    return _shown(fit_by_group(df, ["moy_gle", "math"], "score_l1", ["cohort"], penalty=0.0), ["cohort"])


@query(f"""WITH {_LEAST_SQUARES} SELECT row_id, a.cohort, round_even((b + c0 * ((moy_gle - m0) / s0) + c1 * ((math - m1) / s1)) * 10, 0) / 10
AS score FROM applicants a JOIN f USING (cohort)""")
def fit_score_by_cohort(spark, sf_dir):
    """Every applicant scored with the model fitted on the own cohort."""
    df = materialize(applicants(spark, sf_dir, ["row_id", "cohort", "moy_gle", "math", "score_l1"]), "applicants")
    models = fit_by_group(df, ["moy_gle", "math"], "score_l1", ["cohort"], penalty=0.0)
    return M.score_with_model_table(df.drop("score_l1"), models, ["moy_gle", "math"], ["cohort"], out="score", digits=1).select(
        "row_id", "cohort", "score"
    )


def _level_sql(rows: str, level: int) -> str:
    """Best splits of the nodes in ``rows`` (node, label, x0, x1, x2)."""
    stacked = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, label FROM {rows}" for i in range(3))
    return f"""cells{level} AS (SELECT node, f, v, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p FROM ({stacked}) GROUP BY ALL),
runs{level} AS (SELECT node, f, v, sum(n) OVER u AS ln, sum(p) OVER u AS lp, lead(v) OVER u AS following,
  sum(n) OVER w AS tn, sum(p) OVER w AS tp FROM cells{level}
  WINDOW u AS (PARTITION BY node, f ORDER BY v), w AS (PARTITION BY node, f)),
scores{level} AS (SELECT *, (lp * lp + (ln - lp) * (ln - lp)) / ln
  + ((tp - lp) * (tp - lp) + ((tn - ln) - (tp - lp)) * ((tn - ln) - (tp - lp))) / (tn - ln) AS score,
  (tp * tp + (tn - tp) * (tn - tp)) / tn AS parent, (v + following) / 2 AS threshold FROM runs{level} WHERE following IS NOT NULL),
best{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, f, threshold) AS place
  FROM scores{level} WHERE score - parent > 1e-9) WHERE place = 1)"""


@query(f"""WITH {APPLICANTS}, rows0 AS (
  SELECT 0 AS node, CASE WHEN resultat <> 'NON ADMIS' THEN 1 ELSE 0 END AS label, moy_gle AS x0, math AS x1, an AS x2 FROM applicants
), {_level_sql("rows0", 0)},
rows1 AS (SELECT CASE WHEN CASE b.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= b.threshold THEN 1 ELSE 2 END AS node, label, x0, x1, x2
  FROM rows0, best0 b),
{_level_sql("rows1", 1)},
splits AS (SELECT * FROM best0 UNION ALL SELECT * FROM best1),
leaves AS (
  SELECT 2 * node + 1 AS node, ln AS n, lp AS p FROM splits UNION ALL SELECT 2 * node + 2, tn - ln, tp - lp FROM splits
)
SELECT CAST(node AS INTEGER) AS node, CASE f WHEN 0 THEN 'moy_gle' WHEN 1 THEN 'math' ELSE 'an' END AS feature, threshold,
  CAST(NULL AS INTEGER) AS prediction FROM splits
UNION ALL SELECT CAST(node AS INTEGER), NULL, NULL, CASE WHEN 2 * p > n THEN 1 ELSE 0 END FROM leaves
WHERE node NOT IN (SELECT node FROM splits)""", name="fit_tree_exact")
def exact_tree(spark, sf_dir):
    """The greedy Gini tree of depth two over all values of three features, nodes numbered like a heap."""
    names = ["moy_gle", "math", "an"]
    df = applicants(spark, sf_dir, [*names, "resultat"])
    tree: TreeArrays = fit_tree_exact(df, names, (F.col("resultat") != "NON ADMIS").cast("int"), max_depth=2)
    heap = {0: 0}
    for i, feature in enumerate(tree.feature):
        if feature != LEAF:
            heap |= {tree.left[i]: 2 * heap[i] + 1, tree.right[i]: 2 * heap[i] + 2}
    rows = [("admission", *{**row, "node": heap[row["node"]]}.values()) for row in tree.rows()]
    return spark.createDataFrame(rows, TREE_TABLE_SCHEMA).select("node", "feature", "threshold", "prediction")
