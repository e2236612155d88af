"""Queries on what is prepared once and used often: page directories, frozen ranks and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions.scalar import ERREUR
from cohorta.operators.features import fit_feature_stats, fit_tree_stats, rename_fields
from cohorta.operators.pages import read_page, write_pages
from cohorta.operators.scoring import Cascade, LinearModel, Split, Term
from cohorta.plans import predict
from cohorta.plans.frozen import freeze, prepare_ranks, thaw
from cohorta.plans.predict import score_applicants
from cohorta.schema import record_to_internal
from cohorta.scratch import materialize, scratch_path
from cohorta.sources.records import records_frame
from cohorta.streaming.score import read_arrivals, read_scored, score_stream
from cohorta.workload.registry import query
from cohorta.workload.scoring import V2
from cohorta.workload.tables import APPLICANTS, CASCADE, DIGITS, RANK_TABLE, TERMS, applicants, rank_reference, table


@query("""SELECT l_orderkey, l_linenumber, place FROM (SELECT l_orderkey, l_linenumber,
  row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS place FROM lineitem)
WHERE place BETWEEN 0 AND 99 OR place BETWEEN 25000 AND 25499""")
def paginate_indexed(spark, sf_dir):
    """The first and a deep page of lines by falling price, from one stored order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    root = scratch_path(spark, "pages")
    version = write_pages(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], root)
    pages = []
    for skip, limit in ((0, 100), (25_000, 500)):
        page = read_page(spark, root, skip, limit, version)
        # A page's place in the whole order is its place on the page and the rows skipped.
        pages.append(page.agg(F.collect_list(F.struct(*page.columns)).alias("rows")).select(F.posexplode("rows").alias("n", "r")).select(
            "r.l_orderkey", "r.l_linenumber", (F.col("n") + skip).cast("long").alias("place")))
    return pages[0].unionByName(pages[1])


@query(f"""WITH {RANK_TABLE} SELECT row_id, score, coalesce(rank, 0) AS rank
FROM (SELECT event_id AS row_id, value AS score FROM events) e ASOF LEFT JOIN ranks ON e.score >= ranks.table_score""")
def asof_prepared(spark, sf_dir):
    """Event values looked up in ranks that were prepared, stored and loaded again."""
    root = scratch_path(spark, "state")
    freeze(spark, root, ranks=prepare_ranks(rank_reference(spark, sf_dir)))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("score"))
    return thaw(spark, root).ranks.lookup(events, "score", "rank")


@query(f"""WITH {RANK_TABLE}, e AS (SELECT event_id AS row_id, value / 10.0 - 20.0 AS score FROM events)
SELECT row_id, score, coalesce(rank, (SELECT max(rank) FROM ranks)) AS rank FROM e ASOF LEFT JOIN ranks ON e.score >= ranks.table_score""")
def asof_miss_last(spark, sf_dir):
    """Scores below the whole table get its last rank, looked up directly and from prepared ranks."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), (F.col("value") / F.lit(10.0) - F.lit(20.0)).alias("score")
    )
    ranks = materialize(rank_reference(spark, sf_dir), "ranks")
    odd = F.col("row_id") % 2 == 1
    direct = predict.asof_lookup(events.where(odd), ranks, "score", "score", "rank", "rank", "row_id", miss="last")
    return direct.unionByName(prepare_ranks(ranks, miss="last").lookup(events.where(~odd), "score", "rank"))


@query(f"""WITH {V2} SELECT row_id, status, score, orientation_probability, success_probability FROM v2
WHERE row_id = (SELECT min(o_orderkey) FROM orders)""")
def single_record(spark, sf_dir):
    """The applicant with the smallest number as a record at hand, answered like a batch of one."""
    df = applicants(spark, sf_dir, ["row_id", "moy_gle", "math"])
    first = df.orderBy("row_id").limit(1).collect()[0]
    record = {"Moy_Gle": first["moy_gle"], "MATH": first["math"]}
    names = record_to_internal()
    frame = rename_fields(records_frame(spark, [record]).select(*record)).select(
        F.lit(first["row_id"]).alias("row_id"), *[names.get(f, f) for f in record]
    )
    out = predict.success_probability_v2(
        score_applicants(frame, CASCADE, digits=DIGITS), rank_reference(spark, sf_dir), "row_id",
        2 * table(spark, sf_dir, "customer").count(),
    )
    return out.select(
        "row_id", F.col("Prediction_Status").alias("status"), F.col("Score_Predit").alias("score"),
        "orientation_probability", "success_probability",
    )


# Routes by the mean of the academy, and asks the region's code and the residence's mean.
_TREES = {
    "admission": Split("moy_gle", 100_000.0, 0, 1),
    "session": Split("academie_perf", 150_000.0, 0, 1),
    "mention": Split("etablissement", 2.0, 0, 1),
}
_TERMS = (*TERMS, Term("residence_perf", 2.0, 150_000.0, 50_000.0))
# The first route has no model: its applicants can't be scored.
_CASCADE = Cascade(
    _TREES,
    {"deuxieme_session": LinearModel(35.0, _TERMS), "passable": LinearModel(60.0, _TERMS), "mention": LinearModel(85.0, _TERMS)},
)
_INPUTS = ["row_id", "moy_gle", "math", "academie", "residence", "etablissement"]


def _frozen_sql(scored: str) -> str:
    return f"""WITH {APPLICANTS},
academies AS (SELECT academie, avg(moy_gle) AS academie_perf FROM applicants GROUP BY academie),
residences AS (SELECT residence, avg(moy_gle) AS residence_perf FROM applicants WHERE residence IS NOT NULL GROUP BY residence),
schools AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
  FROM (SELECT DISTINCT coalesce(etablissement, 'nan') AS label FROM applicants)),
routed AS (
  SELECT a.*, coalesce(residence_perf, 0.0) AS r, CASE WHEN moy_gle <= 100000 THEN NULL WHEN academie_perf <= 150000 THEN 'deuxieme_session'
    WHEN code <= 2 THEN 'passable' ELSE 'mention' END AS model_key
  FROM applicants a LEFT JOIN academies USING (academie) LEFT JOIN residences USING (residence)
  LEFT JOIN schools ON label = coalesce(etablissement, 'nan')
),
scored AS (
  SELECT row_id, CASE model_key WHEN 'deuxieme_session' THEN 'DEUXIÈME SESSION' WHEN 'passable' THEN 'PASSABLE'
      WHEN 'mention' THEN 'MENTION SUPÉRIEURE' ELSE 'ERREUR' END AS status,
    CASE WHEN model_key IS NOT NULL THEN round_even(((CASE model_key WHEN 'deuxieme_session' THEN 35.0 WHEN 'passable' THEN 60.0 ELSE 85.0 END)
      + 5.0 * ((moy_gle - 250000.0) / 144000.0) + 3.0 * ((math - 25.0) / 10.0) + 2.0 * ((r - 150000.0) / 50000.0)) * 10000.0, 0) / 10000.0 END AS score
  FROM routed
), {scored}"""


@query(_frozen_sql(V2[V2.index("ranks AS (") :] + """
SELECT row_id, status, score, orientation_probability, success_probability, false AS rejected FROM v2 WHERE status <> 'ERREUR'
UNION ALL SELECT row_id, status, NULL, NULL, NULL, true FROM scored WHERE status = 'ERREUR'"""))
def stream_predict_frozen(spark, sf_dir):
    """Arriving applicants scored with codes, means and ranks learned beforehand; the others go to a sink of their own."""
    known = materialize(applicants(spark, sf_dir, _INPUTS), "applicants")
    root, arriving = scratch_path(spark, "state"), scratch_path(spark, "arrivals")
    freeze(
        spark, root, prepare_ranks(rank_reference(spark, sf_dir)),
        {
            "trees": fit_tree_stats(known, labels=("etablissement",)),
            "models": fit_feature_stats(known, labels=(), group_columns={"residence_perf": "residence"}),
        },
    )
    known.write.parquet(arriving)
    state, capacity = thaw(spark, root), 2 * table(spark, sf_dir, "customer").count()

    def score(batch):
        rows = score_applicants(batch, _CASCADE, state.stats["models"], state.stats["trees"], digits=DIGITS)
        return predict.success_probability_v2(rows, state.ranks, "row_id", capacity=capacity)

    sink, rejects = scratch_path(spark, "stream"), scratch_path(spark, "rejects")
    arrivals = read_arrivals(spark, arriving, known.schema)
    score_stream(arrivals, score, sink, scratch_path(spark, "stream-state"), rejects=rejects).awaitTermination()
    good, bad = (read_scored(spark, s) for s in (sink, rejects))
    none = [F.lit(None).cast("double").alias(c) for c in ("score", "orientation_probability", "success_probability")]
    return good.select(
        "row_id", F.col("Prediction_Status").alias("status"), F.col("Score_Predit").alias("score"),
        "orientation_probability", "success_probability", F.lit(False).alias("rejected"),
    ).unionByName(
        bad.where(F.col("Prediction_Status") == ERREUR).select(
            "row_id", F.col("Prediction_Status").alias("status"), *none, F.lit(True).alias("rejected")
        )
    )
