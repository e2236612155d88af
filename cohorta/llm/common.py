"""What the text operators share: reading tables and appending computed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

# Texts handed to a compute function at once.
BATCH_TEXTS = 512

Compute = Callable[[list], Sequence]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns of these names (in any case): results replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def unused_name(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name in taken:
        name += "_"
    return name


def append_columns(
    df: DataFrame, column: str, fields: str, make: Callable[[], Compute], batch: int = BATCH_TEXTS
) -> DataFrame:
    """Keep every row and column of ``df`` and append ``fields``.

    ``make`` runs once per task and gives a function from a list of values of
    ``column`` (None for null) to one sequence per field. Input columns that
    carry the name of a field are replaced. Rows are neither moved nor counted,
    so the step has no shuffle and a lost task is simply run again.
    """
    added = _parse_datatype_string(fields)
    kept = without(df, [f.name for f in added if f.name.lower() != column.lower()])
    schema = StructType([*kept.schema.fields, *added.fields])
    if column.lower() in {f.name.lower() for f in added}:
        raise ValueError(f"{column} is an input and can't be an output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        compute = make()
        types = [to_arrow_type(f.dataType) for f in added.fields]
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                values = part.column(part.schema.get_field_index(column)).to_pylist()
                made = [pa.array(v, type=t, from_pandas=False) for v, t in zip(compute(values), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)
