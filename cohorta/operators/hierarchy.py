"""Three-level hierarchy: flatten, refresh, append, nest, look up, count."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions.scalar import as_column
from cohorta.operators.slicing import number_rows
from cohorta.scratch import materialize
from cohorta.sources.versions import VersionLog

DOCUMENT_TYPE = "map<string,map<string,array<string>>>"
LEVELS = ("regions", "academies", "residences")

# Names per page of a nested region; longer regions continue on further pages.
PAGE_ROWS = 1_000

# Documents longer than this are cut into their top-level entries, which many tasks parse.
SPLIT_CHARS = 1 << 20
# A JSON string, and a member whose value is an object of lists of strings. Possessive, so
# that a long member neither backtracks nor takes stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MEMBER = rf"{_STRING}\s*+:\s*+\{{(?:[^{{}}\"]++|{_STRING})*+\}}"


def split_documents(docs: DataFrame) -> DataFrame:
    """(doc, p1, text): each top-level entry of the documents as a document of its own.

    ``p1`` is the entry's place. Finding the entries is one pass over a document's
    characters; the entries are then spread, so that a large one is parsed by many tasks.
    A text that is not an object of such entries, with commas between them, raises.
    """
    members = F.regexp_extract_all("text", F.lit(_MEMBER), F.lit(0))
    # A control character, which no JSON text holds as it is, stands for each entry.
    rest = F.regexp_replace("text", _MEMBER, "\x01")
    sound = rest.rlike(r"\A\s*\{\s*(\x01\s*(,\s*\x01\s*)*)?\}\s*\z")
    entries = F.when(sound, members).otherwise(
        F.raise_error(F.concat(F.lit("Malformed hierarchy document "), F.col("doc").cast("string")))
    )
    found = docs.where(F.col("text").isNotNull()).select("doc", F.posexplode(entries).alias("p1", "entry"))
    # A fixed number of tasks: few large entries must not be gathered again.
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = found.repartition(width, "doc", "p1")
    return spread.select("doc", "p1", F.concat(F.lit("{"), "entry", F.lit("}")).alias("text"))


def _region_entries(docs: DataFrame, split_chars: int) -> DataFrame:
    """(doc, p1, region_entry) of all documents, the long ones by way of their parts."""
    tree = F.from_json("text", DOCUMENT_TYPE, {"mode": "FAILFAST"})
    long = F.length("text") > split_chars
    whole = docs.where(~F.coalesce(long, F.lit(False))).select("doc", F.posexplode(F.map_entries(tree)).alias("p1", "region_entry"))
    parts = split_documents(docs.where(long)).select("doc", "p1", F.explode(F.map_entries(tree)).alias("region_entry"))
    return whole.unionByName(parts)


def flatten_documents(docs: DataFrame, split_chars: int = SPLIT_CHARS) -> dict[str, DataFrame]:
    """Nested documents ``(doc, text)`` to three keyed tables.

    Ids follow the order of first appearance.  A name met again under the same
    parent, in another document, is the same entry.  Documents longer than
    ``split_chars`` are parsed in parts.
    """
    regions = _region_entries(docs, split_chars)
    academies = regions.select(
        "doc", "p1", F.col("region_entry.key").alias("region"),
        F.posexplode_outer(F.map_entries("region_entry.value")).alias("p2", "academy_entry"),
    )
    leaves = academies.select(
        "doc", "p1", "p2", "region", F.col("academy_entry.key").alias("academie"),
        F.posexplode_outer("academy_entry.value").alias("p3", "residence"),
    )
    # Three levels are numbered from it: parse the documents once.
    leaves = materialize(leaves, "leaves")

    def keyed(level: Sequence[str], place: Sequence[str]) -> DataFrame:
        seen = leaves.where(F.col(level[-1]).isNotNull())
        first = seen.groupBy(*level).agg(F.min(F.struct("doc", *place)).alias("__first"))
        return number_rows(first, ["__first"], "id").drop("__first")

    region_ids = keyed(["region"], ["p1"])
    academy_ids = keyed(["region", "academie"], ["p1", "p2"])
    residence_ids = keyed(["region", "academie", "residence"], ["p1", "p2", "p3"])
    regions_out = region_ids.select("id", F.col("region").alias("name"))
    academies_out = academy_ids.join(
        region_ids.select("region", F.col("id").alias("region_id")), "region"
    )
    residences_out = residence_ids.join(
        academy_ids.select("region", "academie", F.col("id").alias("academie_id")),
        ["region", "academie"],
    )
    return {
        "regions": regions_out,
        "academies": academies_out.select("id", F.col("academie").alias("name"), "region_id"),
        "residences": residences_out.select("id", F.col("residence").alias("name"), "academie_id"),
    }


def repeated_names(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(level, name, n)``: names that occur more than once on their level."""
    counts = [
        df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(level).alias("level"), "name", "n")
        for level, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _folders(content: Mapping) -> list[str]:
    return [folder for folders in content["tables"].values() for folder in folders]


def _write(spark: SparkSession, root: str, level: str, df: DataFrame) -> str:
    """Write rows of a level into a folder of its own, named relative to ``root``."""
    folder = f"{level}/part={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    return folder


def _read(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    parts = [spark.read.parquet(f"{root}/{folder}") for folder in folders]
    return reduce(DataFrame.unionByName, parts)


def refresh_hierarchy(spark: SparkSession, tables: Mapping[str, DataFrame], root: str) -> int:
    """Replace all tables at once and return the new version.

    The tables go into folders of this writer's own; only the version, committed
    last, makes them current.  A job that fails on the way leaves the old
    tables in place, and so does a name that is repeated on its level: it raises,
    and its folders go.  Of two writers at once both are committed, one after the other.
    """
    log, written = VersionLog(spark, root), {}
    for level, df in tables.items():
        written[level] = [_write(spark, root, level, df)]
    stored = {level: _read(spark, root, folders).select(tables[level].columns) for level, folders in written.items()}
    twice = repeated_names(stored).first()
    if twice is not None:
        for folder in _folders({"tables": written}):
            log.remove(folder)
        raise ValueError(f"{twice['level']}: {twice['name']!r} occurs {twice['n']} times")
    return log.update(lambda version, content: {"tables": {**content.get("tables", {}), **written}})


def read_hierarchy(spark: SparkSession, root: str, levels: Sequence[str] = LEVELS) -> dict[str, DataFrame]:
    """The tables of the latest version."""
    version, content = VersionLog(spark, root).latest()
    if version == 0:
        raise FileNotFoundError(f"no committed hierarchy in {root}")
    return {level: _read(spark, root, content["tables"][level]) for level in levels}


def append_hierarchy(
    spark: SparkSession,
    root: str,
    level: str,
    incoming: DataFrame,
    parent_level: str | None = None,
    parent_key: str | None = None,
    order_by: str = "seq",
) -> tuple[int, DataFrame]:
    """Append new entries to a stored level; returns the new version and the rejected rows.

    The rows are judged as ``append_entries`` does, against the version they are
    appended to: if another writer commits first, they are judged and numbered
    anew, so ids and names stay unique and no writer's rows are lost.
    """
    log, rejected, tried = VersionLog(spark, root), None, []

    def change(version: int, content: dict) -> dict:
        nonlocal rejected
        if not version:
            raise FileNotFoundError(f"no committed hierarchy in {root}")
        for folder in tried:
            log.remove(folder)
        tables = content["tables"]
        parents = _read(spark, root, tables[parent_level]) if parent_level else None
        accepted, judged = append_entries(_read(spark, root, tables[level]), incoming, parents, parent_key, order_by)
        rejected = materialize(judged, "rejected")
        tried[:] = [_write(spark, root, level, accepted)]
        return {**content, "tables": {**tables, level: [*tables[level], *tried]}}

    return log.update(change), rejected


def expire_hierarchy(spark: SparkSession, root: str, keep: int = 2, min_age_seconds: float = 86_400.0) -> list[str]:
    """Remove the folders that the last ``keep`` versions don't need, and those of writers that failed long ago."""
    return VersionLog(spark, root).expire(keep, _folders, min_age_seconds)


def append_entries(
    existing: DataFrame,
    incoming: DataFrame,
    parents: DataFrame | None = None,
    parent_key: str | None = None,
    order_by: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """Split incoming ``(seq, name[, parent])`` rows into accepted and rejected.

    Accepted rows get ids after the highest existing one, in ``order_by`` order.
    Rejected are unknown parents, names already present, and repeats in the
    batch (the first one counts), with the reason.
    """
    checked = incoming.withColumn("__orphan", F.lit(False))
    if parents is not None:
        known = parents.select(F.col("id").alias(parent_key), F.lit(True).alias("__known"))
        checked = incoming.join(known, parent_key, "left").withColumn(
            "__orphan", F.col("__known").isNull()
        ).drop("__known")
    # One row per name says both whether it is taken and who comes first, so a
    # much repeated name is met in a single join.  Stored, the two sides of that
    # join are plain shuffles, which adaptive execution can split.
    stored = existing.select("name", F.lit(True).alias("__taken"), F.lit(None).alias("__seq"))
    asking = checked.where(~F.col("__orphan")).select(
        "name", F.lit(False).alias("__taken"), F.col(order_by).alias("__seq")
    )
    facts = stored.union(asking).groupBy("name").agg(
        F.max("__taken").alias("__taken"), F.min("__seq").alias("__first")
    )
    checked = checked.join(materialize(facts, "names"), "name", "left")
    reason = (
        F.when(F.col("__orphan"), "unknown_parent")
        .when(F.col("__taken"), "name_exists")
        .when(F.col(order_by) > F.col("__first"), "repeated_in_batch")
    )
    checked = checked.withColumn("reason", reason).drop("__orphan", "__taken", "__first")
    rejected = checked.where(F.col("reason").isNotNull())
    accepted = number_rows(checked.where(F.col("reason").isNull()).drop("reason"), [order_by], "__n")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last")).scalar()
    columns = ["id", "name", *([parent_key] if parent_key else [])]
    return accepted.withColumn("id", last + F.col("__n")).select(*columns), rejected


def nest_regions(
    regions: DataFrame, academies: DataFrame, residences: DataFrame, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Region -> academies -> residences, as ``(region_id, region, page, academies)``.

    ``academies`` is an array of (name, residences).  A region fits on page 0
    unless it has more than ``page_rows`` entries; then it continues, in id
    order, on further pages, and an academy may be split over two of them, so
    no row grows with the data.
    """
    tops = regions.select(F.col("id").alias("region_id"), F.col("name").alias("region"))
    middles = academies.select(
        F.col("id").alias("academie_id"), F.col("name").alias("academie"), "region_id"
    ).join(tops, "region_id")
    bottoms = residences.select(
        F.col("id").alias("residence_id"), F.col("name").alias("residence"), "academie_id"
    )
    # The many children drive inner joins, whose skew adaptive execution can
    # split on either side; parents without children are added apart.
    bare_middles = middles.join(bottoms.select("academie_id").distinct(), "academie_id", "left_anti")
    bare_tops = tops.join(middles.select("region_id").distinct(), "region_id", "left_anti")
    leaves = (
        bottoms.join(middles, "academie_id")
        .unionByName(bare_middles, allowMissingColumns=True)
        .unionByName(bare_tops, allowMissingColumns=True)
    )
    numbered = number_rows(leaves, ["region_id", "academie_id", "residence_id"], "__n")
    first = materialize(numbered.groupBy("region_id").agg(F.min("__n").alias("__first")), "starts")
    paged = numbered.join(first, "region_id").withColumn(
        "page", F.floor((F.col("__n") - F.col("__first")) / F.lit(page_rows))
    )
    # Spread by page, not by region, before the names are collected.
    by_academy = paged.repartition("region_id", "page").groupBy("region_id", "region", "page", "academie_id", "academie").agg(
        F.collect_list(F.when(F.col("residence").isNotNull(), F.struct("residence_id", "residence"))).alias("__rows")
    )
    entry = F.struct(
        "academie_id",
        F.col("academie").alias("name"),
        F.transform(F.array_sort("__rows"), lambda r: r["residence"]).alias("residences"),
    )
    by_page = by_academy.groupBy("region_id", "region", "page").agg(
        F.collect_list(F.when(F.col("academie_id").isNotNull(), entry)).alias("__entries")
    )
    return by_page.select(
        "region_id", "region", "page",
        F.transform(
            F.array_sort("__entries"),
            lambda a: F.struct(a["name"].alias("name"), a["residences"].alias("residences")),
        ).alias("academies"),
    )


def lookup_by_id(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Each wanted id with its row, and whether it was found."""
    hit = table.withColumn("__hit", F.lit(True))
    return wanted.join(hit, key, "left").withColumn(
        "found", F.coalesce("__hit", F.lit(False))
    ).drop("__hit")


def children_of_parents(wanted: DataFrame, parents: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    """Children of the wanted parents that exist: ``(parent_id, child_id, child_name)``.

    A parent without children keeps one row with a null child; unknown parents
    are in ``unknown_parents``.
    """
    known = materialize(wanted.join(parents.select("id"), "id", "left_semi"), "parents")
    kids = children.select(
        as_column(parent_key).alias("id"), F.col("id").alias("child_id"), F.col("name").alias("child_name")
    )
    bare = known.join(kids.select("id").distinct(), "id", "left_anti")
    found = kids.join(known, "id").unionByName(bare, allowMissingColumns=True)
    return found.withColumnRenamed("id", "parent_id")


def unknown_parents(wanted: DataFrame, parents: DataFrame) -> DataFrame:
    """Wanted ids that have no row among the parents."""
    return wanted.join(parents.select("id"), "id", "left_anti")


def count_tables(tables: Mapping[str, DataFrame], prefix: str = "total_") -> DataFrame:
    """Row counts of several tables in one row."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(
        *[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(f"{prefix}{n}") for n in tables]
    )
