"""Lines that many documents share, found by ordered hashes and left out by run-length bitmaps."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.common import without
from cohorta.scratch import materialize

# White space that does not count at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lower(line: Column) -> Column:
    """A-Z in lower case, other letters as they are. Where all characters are ASCII, ``lower`` does no more."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(
        F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    )


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(1), whole), F.xxhash64(F.lit(2), whole)


def _hashed(df: DataFrame, text: str, id_col: str, min_chars: int) -> DataFrame:
    """(row, id, key1, key2, hashes) of every row; lines shorter than ``min_chars`` have a null hash."""
    keys = F.transform(_lines(F.col(text)), lambda line: _lower(F.btrim(line, F.lit(BLANKS))))
    hashes = F.transform(
        keys,
        lambda k: F.when(
            F.char_length(k) >= min_chars,
            F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")),
        ),
    )
    key1, key2 = _text_key(F.col(text))
    return df.select(
        # Fixed from here on, because the rows are written.
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"), key1.alias("key1"), key2.alias("key2"), hashes.alias("hashes"),
    )


def line_bitmaps(
    df: DataFrame, min_documents: int = 10, min_chars: int = 1, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, key1, key2, n_dropped, dropped) of every document that loses lines.

    ``dropped`` is the document's keep bitmap in compressed form: its runs of zeros,
    ascending, as (first, lines); all other bits are ones. ``key1`` and ``key2`` stand for
    the text, so that repeated ids don't mix; rows equal in id and text share one bitmap.

    A line's key is the line without white space at its ends, A-Z in lower case, known
    by 128 bits of hash. Occurrences are range-partitioned by hash and document and
    sorted by position behind these. A document's first occurrence of a key counts it
    once; keys of at least ``min_chars`` code points counted in ``min_documents`` rows or
    more lose all their lines. The range a frequent key ends up in is part of the join
    that marks its lines, so no task holds more of a key than one range.
    """
    hashed = materialize(_hashed(df, f"`{text}`", f"`{id_col}`", min_chars), "line-hashes")
    lines = (
        hashed.select("row", F.posexplode("hashes").alias("position", "h"))
        .where(F.col("h").isNotNull())
        .select(F.col("h.a").alias("a"), F.col("h.b").alias("b"), "row", "position")
    )
    # The window needs no exchange and no sort: the ranges are cut and ordered by its keys.
    ordered = lines.repartitionByRange("a", "b", "row").sortWithinPartitions("a", "b", "row", "position")
    stream = Window.partitionBy("a", "b", "row").orderBy("position")
    first = (F.row_number().over(stream) == 1).cast("int")
    ranged = materialize(ordered.withColumns({"first": first, "range": F.spark_partition_id()}), "line-ranges")

    counted = ranged.groupBy("a", "b").agg(F.sum("first").alias("documents"), F.collect_set("range").alias("ranges"))
    frequent = counted.where(F.col("documents") >= min_documents).select("a", "b", F.explode("ranges").alias("range"))
    marked = ranged.join(materialize(frequent, "frequent-lines"), ["range", "a", "b"], "left_semi").select("row", "position")

    # Positions that follow each other have the same distance to their number.
    number = F.row_number().over(Window.partitionBy("row").orderBy("position"))
    runs = (
        marked.withColumn("run", F.col("position") - number)
        .groupBy("row", "run")
        .agg(F.min("position").alias("first"), F.count(F.lit(1)).cast("int").alias("lines"))
    )
    bitmaps = runs.groupBy("row").agg(
        F.sum("lines").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("first", "lines"))).alias("dropped")
    )
    return (
        hashed.select("row", "id", "key1", "key2")
        .join(bitmaps, "row")
        .groupBy("id", "key1", "key2")
        .agg(F.first("n_dropped").alias("n_dropped"), F.first("dropped").alias("dropped"))
    )


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines outside the runs, joined again."""

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(
            F.element_at(dropped, F.greatest(i, F.lit(1)))["first"] + F.element_at(dropped, F.greatest(i, F.lit(1)))["lines"]
        )
        end = F.when(i == F.size(dropped), F.size(lines)).otherwise(
            F.element_at(dropped, F.least(i + 1, F.size(dropped)))["first"]
        )
        return F.slice(lines, start + 1, end - start)

    parts = F.transform(F.sequence(F.lit(0), F.size(dropped)), between)
    return F.array_join(F.flatten(parts), "\n")


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row of ``df`` with ``n_lines``, ``n_dropped`` and ``kept_text``; rows without a bitmap keep all lines."""
    kept = without(df, [c for c in ("n_lines", "n_dropped", "kept_text") if c not in (text, id_col)])
    key1, key2 = _text_key(F.col("__doc")[text])
    docs = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("__doc"))
    found = bitmaps.select(F.struct("*").alias("__bits"))
    same = (
        F.col("__doc")[id_col].eqNullSafe(F.col("__bits.id"))
        & (key1 == F.col("__bits.key1"))
        & (key2 == F.col("__bits.key2"))
    )
    lines, dropped = _lines(F.col("__doc")[text]), F.col("__bits.dropped")
    joined = docs.join(found, same, "left").select(
        "__doc",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.col("__bits.n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(dropped.isNull(), F.coalesce(F.col("__doc")[text], F.lit(""))).otherwise(_kept(lines, dropped)).alias("kept_text"),
    )
    return joined.select("__doc.*", "n_lines", "n_dropped", "kept_text")


def dedup_lines(
    df: DataFrame, min_documents: int = 10, min_chars: int = 1, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Every row of ``df`` with ``n_lines``, ``n_dropped`` and ``kept_text``, its text without the lines many rows share.

    A null or empty text is one empty line. Each row counts as a document, also where ids
    are null or repeated; a line repeated in a text counts once and goes as a whole. Texts
    of any length are taken whole; a text whose lines all go becomes empty. Other
    columns pass through, those named like a result are replaced. An empty table gives
    an empty one.
    """
    return apply_bitmaps(df, line_bitmaps(df, min_documents, min_chars, text, id_col), text, id_col)
