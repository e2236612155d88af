"""Readers and writers: applicant files, rank files, hierarchy documents, model tables."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta import schema
from cohorta.functions.scalar import as_column, parse_number
from cohorta.operators.features import cohort_prep, stack_cohorts
from cohorta.operators.slicing import number_rows

# Texts that count as missing in applicant files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

MODEL_TABLE_SCHEMA = (
    "cohort string, model_key string, ord int, feature string, "
    "coef double, mean double, scale double, intercept double"
)
TREE_TABLE_SCHEMA = (
    "model_key string, node int, feature string, threshold double, "
    "left int, right int, prediction int"
)


def _files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files under ``path``, grouped by their first line.

    Several files are looked through in one job, which reads the first block of
    each; what comes back is one line per distinct header, and the file names.
    """
    lines = spark.read.text(path)
    if len(lines.inputFiles()) <= 1:
        first = lines.first()
        if first is None:
            raise ValueError(f"no header in {path}")
        return {first["value"]: [path]}
    firsts = (
        lines.select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        .where("block = 0")
        .groupBy("file")
        .agg(F.min_by("value", "line").alias("header"))
    )
    found = firsts.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    # Names come back encoded as in an address; readers take plain ones, in which these signs are patterns.
    return {
        r["header"]: [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for f in r["files"]]
        for r in sorted(found, key=lambda r: r["files"])
    }


def _typed(value: Column, kind: str) -> Column:
    """A text as its column's type; null when it does not fit, so that no number is cut."""
    if kind == "string":
        return value
    parsed = parse_number(value)
    if kind != "int":
        return parsed.cast(kind)
    return F.when(parsed == F.rint(parsed), parsed.try_cast("int"))


def read_csv_table(
    spark: SparkSession,
    path: str,
    names: Mapping[str, tuple[str, str]] = schema.APPLICANT_COLUMNS,
    skip_initial_space: bool = False,
    row_id: str | None = None,
) -> DataFrame:
    """CSV with a header; columns are found by the header, renamed and typed.

    Each file of a folder is read by its own header: columns may stand in
    another order, and one that a file lacks is null there.  Columns without an
    entry in ``names`` stay text under an ASCII form of their name.  Blank-like
    texts are null, as is a number that does not parse or does not fit its type.
    ``row_id`` numbers the rows in file order.
    """
    parts = [
        _read_alike(spark, files, header, names, skip_initial_space)
        for header, files in _files_by_header(spark, path).items()
    ]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = ["__file", "__block", "__line"]
    if row_id is None:
        return raw.drop(*order)
    return number_rows(raw, order, row_id, start=0).drop(*order)


def _read_alike(
    spark: SparkSession, files: list[str], header: str, names: Mapping[str, tuple[str, str]], skip_initial_space: bool
) -> DataFrame:
    """Files with the same header, and the place of each row."""
    header = next(csv.reader([header]))
    if skip_initial_space:
        header = [h.lstrip() for h in header]
    fields = [names.get(h, (re.sub(r"\W+", "_", h.strip()).lower(), "string")) for h in header]
    raw = (
        spark.read.schema(", ".join(f"`{name}` string" for name, _ in fields))
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", skip_initial_space)
        .csv(files)
    )
    columns = []
    for name, kind in fields:
        value = F.when(~F.col(f"`{name}`").isin(*MISSING_TEXTS), F.col(f"`{name}`"))
        columns.append(_typed(value, kind).alias(name))
    place = [
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    ]
    return raw.select(*columns, *place)


def read_cohorts(spark: SparkSession, paths: Mapping[str, str], row_id: str = "row_id") -> DataFrame:
    """All cohort files in one frame, with the cohort name and the place in the file."""
    return stack_cohorts({c: read_csv_table(spark, p, row_id=row_id) for c, p in paths.items()})


def load_cohort(spark: SparkSession, path: str, row_id: str | None = None) -> DataFrame:
    """Read one cohort file and prepare it."""
    return cohort_prep(read_csv_table(spark, path, row_id=row_id))


def read_rank_table(spark: SparkSession, path: str) -> DataFrame:
    """Score to rank file; spaces before values are skipped."""
    names = {"Score L1": ("score", "string"), "Rang L1": ("rank", "string")}
    return read_csv_table(spark, path, names, skip_initial_space=True)


def select_fields(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Project and rename at the scan, so that only these columns are read."""
    return df.select(*[as_column(source).alias(name) for source, name in fields.items()])


def read_hierarchy_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Hierarchy documents as ``(doc, text)``: one per file, or one per line.

    ``doc`` orders the documents by file, and by line within a file.
    """
    lines = spark.read.text(path, wholetext=one_per_file)
    place = [
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    ]
    rows = lines.select(F.col("value").alias("text"), *place)
    return number_rows(rows, ["__file", "__block", "__line"], "doc").select("doc", "text")


def write_model_tables(models: DataFrame, trees: DataFrame, folder: str) -> None:
    """Store the parameters of linear models and trees as two tables."""
    models.write.mode("overwrite").parquet(f"{folder}/linear")
    trees.write.mode("overwrite").parquet(f"{folder}/trees")


def read_model_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The parameter tables of linear models and trees."""
    linear = spark.read.schema(MODEL_TABLE_SCHEMA).parquet(f"{folder}/linear")
    trees = spark.read.schema(TREE_TABLE_SCHEMA).parquet(f"{folder}/trees")
    return linear, trees
