"""Applicant records: 25 typed fields, all of them required."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta import schema
from cohorta.functions.scalar import as_column
from cohorta.operators.features import rename_fields

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}

RECORD_SCHEMA = T.StructType([
    T.StructField(field, _TYPES[schema.APPLICANT_COLUMNS[column][1]])
    for field, column in schema.RECORD_FIELDS.items()
])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Applicant records from JSON lines."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def records_frame(spark: SparkSession, records: Sequence[Mapping[str, object]]) -> DataFrame:
    """A frame from records at hand, such as a single applicant."""
    rows = [tuple(r.get(f.name) for f in RECORD_SCHEMA.fields) for r in records]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete records under the names used here, and the others with what they lack."""
    missing = F.filter(
        F.array(*[F.when(as_column(f).isNull(), F.lit(f)) for f in schema.RECORD_FIELDS]),
        lambda name: name.isNotNull(),
    )
    checked = records.withColumn("missing", missing)
    complete = checked.where(F.size("missing") == 0).drop("missing")
    return rename_fields(complete), checked.where(F.size("missing") > 0)
