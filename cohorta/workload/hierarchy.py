"""Hierarchy queries: region -> nation -> supplier as the three levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.operators import hierarchy as H
from cohorta.scratch import scratch_path
from cohorta.sources.tables import read_hierarchy_documents
from cohorta.workload.registry import query
from cohorta.workload.tables import table


def levels(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    return {
        "regions": region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "academies": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                                   F.col("n_regionkey").alias("region_id")),
        "residences": supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                      F.col("s_nationkey").alias("academie_id")),
    }


def _documents(spark, sf_dir):
    """Small JSON documents: for every 64 suppliers, the nested names they belong to."""
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.floor(F.col("s_suppkey") / 64).alias("part"), "s_suppkey", "s_name", "n_name", "r_name")
    )
    # At most 64 names meet in one document.
    names = suppliers.groupBy("part", "r_name", "n_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"]).alias("names")
    )

    def members(name, text):
        return F.array_join(F.array_sort(F.collect_list(F.format_string('"%s": %s', name, text))), ", ")

    nations = names.groupBy("part", "r_name").agg(members("n_name", F.to_json("names")).alias("nations"))
    docs = nations.groupBy("part").agg(members("r_name", F.format_string("{%s}", "nations")).alias("regions"))
    return docs.select(F.col("part").alias("doc"), F.format_string("{%s}", "regions").alias("text"))


FLAT = """
parts AS (SELECT s_suppkey // 64 AS doc, s_suppkey, r_name, n_name, s_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
first_region AS (SELECT r_name, min(doc) AS doc FROM parts GROUP BY r_name),
regions AS (SELECT r_name, row_number() OVER (ORDER BY doc, r_name) AS region_id FROM first_region),
first_nation AS (SELECT r_name, n_name, min(doc) AS doc FROM parts GROUP BY r_name, n_name),
nations AS (SELECT r_name, n_name, row_number() OVER (ORDER BY doc, r_name, n_name) AS academie_id FROM first_nation),
leaves AS (SELECT *, row_number() OVER (ORDER BY doc, r_name, n_name, s_suppkey) AS residence_id FROM parts)"""

_FLAT_ROWS = """SELECT residence_id, s_name AS residence, academie_id, n_name AS academie, region_id, r_name AS region
FROM leaves JOIN nations USING (r_name, n_name) JOIN regions USING (r_name)"""


def _joined(tables):
    """The three keyed tables read side by side, one row per residence."""
    regions = tables["regions"].select(F.col("id").alias("region_id"), F.col("name").alias("region"))
    academies = tables["academies"].select(F.col("id").alias("academie_id"), F.col("name").alias("academie"), "region_id")
    residences = tables["residences"].select(F.col("id").alias("residence_id"), F.col("name").alias("residence"), "academie_id")
    return residences.join(academies, "academie_id").join(regions, "region_id").select(
        "residence_id", "residence", "academie_id", "academie", "region_id", "region"
    )


@query(f"WITH {FLAT} {_FLAT_ROWS}")
def hierarchy_flatten(spark, sf_dir):
    """Documents written one per line, read back and flattened."""
    path = scratch_path(spark, "documents")
    _documents(spark, sf_dir).orderBy("doc").select("text").write.text(path)
    return _joined(H.flatten_documents(read_hierarchy_documents(spark, path, one_per_file=False)))


@query("""WITH p AS (
  SELECT s_suppkey, s_name, n_name, concat(r_name, ' "', CAST(s_suppkey % 40 AS VARCHAR), '" {', n_name, '}') AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), r AS (SELECT region, row_number() OVER (ORDER BY region) AS region_id FROM (SELECT DISTINCT region FROM p)),
a AS (SELECT region, n_name, row_number() OVER (ORDER BY region, n_name) AS academie_id FROM (SELECT DISTINCT region, n_name FROM p))
SELECT row_number() OVER (ORDER BY region, n_name, s_suppkey) AS residence_id, s_name AS residence, academie_id, n_name AS academie,
  region_id, region FROM p JOIN r USING (region) JOIN a USING (region, n_name)""")
def hierarchy_flatten_large(spark, sf_dir):
    """One document of all suppliers, cut at its top level; names hold quotes and braces."""
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "s_suppkey", "s_name", "n_name",
            F.format_string('%s "%d" {%s}', "r_name", F.col("s_suppkey") % 40, "n_name").alias("region"),
        )
    )
    names = suppliers.groupBy("region", "n_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"]).alias("names")
    )
    regions = names.groupBy("region").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "names")))).alias("academies")
    )
    member = F.to_json(F.create_map("region", "academies"))
    member = F.struct("region", F.substring(member, F.lit(2), F.length(member) - 2).alias("text"))
    # The feature is one document that holds everything.
    members = F.transform(F.array_sort(F.collect_list(member)), lambda m: m["text"])
    docs = regions.agg(F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}")).alias("text"))
    path = scratch_path(spark, "document")
    docs.write.text(path)
    return _joined(H.flatten_documents(read_hierarchy_documents(spark, path, one_per_file=False), split_chars=0))


@query("""SELECT s_suppkey AS residence_id, s_name AS residence, n_nationkey AS academie_id, n_name AS academie,
r_regionkey AS region_id, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")
def hierarchy_refresh(spark, sf_dir):
    """Two refreshes; the second one's tables are read back."""
    root = scratch_path(spark, "hierarchy")
    tables = levels(spark, sf_dir)
    H.refresh_hierarchy(spark, {n: df.where(F.col("id") < 3) for n, df in tables.items()}, root)
    H.refresh_hierarchy(spark, tables, root)
    return _joined(H.read_hierarchy(spark, root))


@query("""SELECT 'regions' AS level, r_name AS name, count(*) AS n FROM region GROUP BY r_name HAVING count(*) > 1
UNION ALL
SELECT 'academies', c_mktsegment, count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
GROUP BY c_mktsegment HAVING count(*) > 1
UNION ALL
SELECT 'residences', p_name, count(*) FROM part GROUP BY p_name HAVING count(*) > 1""")
def hierarchy_duplicate_names(spark, sf_dir):
    """Names that would make a refresh fail: market segments of several nations, parts of one name."""
    segments = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("name")).distinct()
    return H.repeated_names({
        "regions": table(spark, sf_dir, "region").select(F.col("r_name").alias("name")),
        "academies": segments,
        "residences": table(spark, sf_dir, "part").select(F.col("p_name").alias("name")),
    })


@query("""WITH incoming AS (
  SELECT c_custkey AS seq, CASE WHEN c_custkey % 5 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 9, '0')
         ELSE 'Place ' || CAST(c_custkey % 500 AS VARCHAR) END AS name,
         CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS academie_id FROM customer
), checked AS (
  SELECT *, academie_id NOT IN (SELECT n_nationkey FROM nation) AS orphan,
         name IN (SELECT s_name FROM supplier) AS taken FROM incoming
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY name, orphan OR taken ORDER BY seq) AS nth FROM checked
), fresh AS (
  SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY seq) AS id, name, academie_id
  FROM judged WHERE NOT orphan AND NOT taken AND nth = 1
)
SELECT 'accepted' AS outcome, id, name, academie_id FROM fresh
UNION ALL
SELECT CASE WHEN orphan THEN 'unknown_parent' WHEN taken THEN 'name_exists' ELSE 'repeated_in_batch' END, seq, name, academie_id
FROM judged WHERE orphan OR taken OR nth > 1""")
def hierarchy_append(spark, sf_dir):
    """A batch of new residences: the stored ones, and the rejects with a reason."""
    tables = levels(spark, sf_dir)
    key = F.col("c_custkey")
    incoming = table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.when(key % 5 == 0, F.concat(F.lit("Supplier#"), F.lpad((key % 1000).cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("Place "), (key % 500).cast("string"))).alias("name"),
        F.when(key % 7 == 0, -1).otherwise(F.col("c_nationkey")).alias("academie_id"),
    )
    root = scratch_path(spark, "hierarchy")
    first = tables["residences"].agg(F.max("id")).scalar()
    H.refresh_hierarchy(spark, tables, root)
    _, rejected = H.append_hierarchy(spark, root, "residences", incoming, "academies", "academie_id")
    stored = H.read_hierarchy(spark, root)["residences"].where(F.col("id") > first)
    return stored.select(F.lit("accepted").alias("outcome"), "id", "name", "academie_id").unionByName(
        rejected.select(F.col("reason").alias("outcome"), F.col("seq").alias("id"), "name", "academie_id")
    )


_PAGE = 40


@query(f"""WITH numbered AS (
  SELECT r_regionkey AS region_id, r_name AS region, n_nationkey, n_name, s_suppkey, s_name,
    (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey, s_suppkey) - 1) // {_PAGE} AS page
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey
), by_nation AS (
  SELECT region_id, region, page, n_nationkey,
    n_name || ':' || coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS entry
  FROM numbered GROUP BY region_id, region, page, n_nationkey, n_name
)
SELECT region_id, region, page, coalesce(string_agg(entry, ';' ORDER BY n_nationkey), '') AS nested
FROM by_nation GROUP BY region_id, region, page""")
def hierarchy_nested(spark, sf_dir):
    """Regions with nested academies and residences, in pages, written out as text."""
    tables = levels(spark, sf_dir)
    nested = H.nest_regions(tables["regions"], tables["academies"], tables["residences"], page_rows=_PAGE)
    entry = F.transform("academies", lambda a: F.concat(a["name"], F.lit(":"), F.array_join(a["residences"], ",")))
    return nested.select("region_id", "region", "page", F.array_join(entry, ";").alias("nested"))


@query("""SELECT l_orderkey AS id, l_linenumber, s_name AS name, s_nationkey AS academie_id, s_suppkey IS NOT NULL AS found
FROM (SELECT l_orderkey, l_linenumber, l_suppkey + 3 AS wanted FROM lineitem) LEFT JOIN supplier ON s_suppkey = wanted""")
def lookup_by_id(spark, sf_dir):
    """A batch of supplier ids, some of which do not exist."""
    wanted = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") + 3).alias("id")
    )
    found = H.lookup_by_id(levels(spark, sf_dir)["residences"], wanted)
    return found.select(F.col("l_orderkey").alias("id"), "l_linenumber", "name", "academie_id", "found")


_WANTED = "(SELECT DISTINCT c_nationkey + 2 AS id FROM customer)"


def _wanted(spark, sf_dir):
    return table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 2).alias("id")).distinct()


@query(f"""SELECT n_nationkey AS parent_id, s_suppkey AS child_id, s_name AS child_name
FROM {_WANTED} w JOIN nation ON n_nationkey = w.id LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def children_of_parent(spark, sf_dir):
    tables = levels(spark, sf_dir)
    out = H.children_of_parents(_wanted(spark, sf_dir), tables["academies"], tables["residences"], "academie_id")
    return out.select("parent_id", "child_id", "child_name")


@query(f"SELECT id FROM {_WANTED} WHERE id NOT IN (SELECT n_nationkey FROM nation)")
def missing_parent_anti(spark, sf_dir):
    return H.unknown_parents(_wanted(spark, sf_dir), levels(spark, sf_dir)["academies"])


@query("""SELECT (SELECT count(*) FROM region) AS total_regions, (SELECT count(*) FROM nation) AS total_academies,
(SELECT count(*) FROM supplier) AS total_residences""")
def table_counts(spark, sf_dir):
    return H.count_tables(levels(spark, sf_dir))
