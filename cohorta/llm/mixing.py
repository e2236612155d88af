"""Interleaving sources to target weights: proportionate fair scheduling of blocks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from cohorta.llm.common import without
from cohorta.scratch import materialize

# Slots scheduled at once, and at most so many where a source has longer windows.
CHUNK, LONGEST_CHUNK = 1000, 20_000
# Rows of one source that one window numbers.
WINDOW_ROWS = 200_000
RESULTS = ("block", "release", "deadline", "slot", "position")


def schedule(units: DataFrame, horizon: int, total: int, longest: int) -> DataFrame:
    """Slots below ``horizon`` from (name, units): name, nth block of its source, slot.

    Block j of a source with units a, of W = ``total`` in all, is released at
    floor(j W / a) and due at ceil((j + 1) W / a). Each slot takes, of the released
    blocks, the one due first (ties: first name). As the units add up to W, every
    block runs within its window, so a source is never a whole block off its target.

    Chunks of slots are scheduled apart, one row each. What ran before slot t is known
    without the slots before it: all blocks due by t, and of the blocks whose window
    holds t (one per source at most) those that still find a free slot, in the order of
    their deadlines. A block finds one if for each u up to its release fewer than t - u
    of the blocks already taken are released at u or later. ``longest`` is the longest window.
    """
    size, w = max(CHUNK, min(longest, LONGEST_CHUNK)), f"{total}L"
    packed = units.agg(F.sort_array(F.collect_list(F.struct("name", "units"))).alias("s")).where("size(s) > 0")
    starts = packed.select("s", F.explode(F.sequence(F.lit(0), F.lit(max(0, horizon - 1) // size))).alias("chunk"))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = starts.repartition(parts, "chunk").withColumn("t0", F.col("chunk").cast("long") * size)
    before = chunks.withColumn("f", F.expr(f"transform(s, x -> x.units * t0 DIV {w})")).withColumn(
        "open",
        F.expr(f"""
          sort_array(transform(filter(sequence(0, size(s) - 1), i -> s[i].units * t0 % {w} > 0), i -> named_struct(
            'due', ((f[i] + 1) * {w} + s[i].units - 1) DIV s[i].units, 'i', i, 'release', f[i] * {w} DIV s[i].units)))
        """),
    ).withColumn("room", F.expr("t0 - aggregate(f, 0L, (n, x) -> n + x)"))
    # Written, as the optimiser would compute a column again for each step of a fold that uses it.
    before = materialize(before.withColumn("low", F.expr("coalesce(array_min(transform(open, x -> x.release)), t0)")), "before")
    # Free slots from each u on; up to the least release the count of all slots decides.
    free = f"""
      if(low + 1 < t0, transform(sequence(low + 1, t0 - 1), u -> t0 - u - aggregate(sequence(0, size(s) - 1), 0L,
        (n, i) -> n + greatest(0L, f[i] - (s[i].units * u + {w} - 1) DIV {w}))), cast(array() as array<bigint>))
    """
    taken = """
      aggregate(open, named_struct('free', free, 'taken', cast(array() as array<int>)), (acc, x) ->
        if(size(acc.taken) < room AND (x.release <= low OR array_min(slice(acc.free, 1, cast(x.release - low as int))) >= 1),
          named_struct('free', transform(acc.free, (n, k) -> if(k < x.release - low, n - 1, n)),
            'taken', concat(acc.taken, array(x.i))), acc), acc -> acc.taken)
    """
    begun = materialize(before.withColumn("free", F.expr(free)).withColumn("taken", F.expr(taken)).drop("free"), "begun")
    begun = begun.select("s", "t0", F.expr("transform(f, (n, i) -> if(array_contains(taken, i), n + 1, n))").alias("done"))
    pick = f"""
      array_min(transform(
        filter(sequence(0, size(s) - 1), i -> acc.done[i] * {w} DIV s[i].units <= t),
        i -> named_struct('due', ((acc.done[i] + 1) * {w} + s[i].units - 1) DIV s[i].units, 'i', i))).i
    """
    fold = f"""
      aggregate(sequence(t0, greatest(t0, least(t0 + {size}, {horizon}L) - 1)),
        named_struct('done', done, 'picks', cast(array() as array<struct<i:int,nth:bigint>>)),
        (acc, t) -> transform(array({pick}), p -> named_struct(
          'done', transform(acc.done, (d, k) -> if(k = p, d + 1L, d)),
          'picks', concat(acc.picks, array(named_struct('i', p, 'nth', acc.done[p])))))[0],
        acc -> acc.picks)
    """
    slots = begun.select("s", "t0", F.expr(fold).alias("picks")).select("s", "t0", F.posexplode("picks").alias("k", "p"))
    return slots.select(F.expr("s[p.i].name").alias("name"), F.expr("p.nth").alias("nth"), F.expr("t0 + k").alias("slot"))


def mix_sources(
    df: DataFrame,
    targets: Mapping[str, int] | None = None,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Append ``block``, ``release``, ``deadline``, ``slot`` and ``position`` to every row.

    ``targets`` gives whole shares by source (sources it lacks have one); without it
    shares follow the square root of a source's rows, not rounded. Rows of a source are taken in
    an order shuffled by ``key`` and ``seed``, ``block_rows`` to a block; sorting by
    ``position`` gives the mixture. No row is left out: as long as every source has
    blocks the mixture is less than one block off its targets at each slot; when a
    source has ended its slots stay empty. Null is a source of its own. The order also
    takes in a hash of a row's plain columns, so rows with equal or null keys are
    spread like others, and the same rows get the same places in every run. An empty table
    gives an empty one; input columns named like a result are replaced, all others kept.
    """
    if block_rows < 1 or any(t < 1 for t in (targets or {}).values()):
        raise ValueError("block_rows and targets must be positive")
    spark = df.sparkSession
    kept = without(df, RESULTS)
    name = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    plain = F.xxhash64(*[F.col(f"`{c.name}`") for c in kept.schema.fields if isinstance(c.dataType, AtomicType)])
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), plain), 1)
    total = df.select(F.count(F.lit(1))).first()[0]
    # Pieces follow the shuffled order, so their number does not change the result.
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // WINDOW_ROWS))
    piece = F.least(F.floor(F.col("__order") / F.lit(2.0**63) * pieces), F.lit(pieces - 1))
    # The row travels as one value, whatever its columns are called.
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("__row")
    named = df.select(row, name.alias("__name"), order.alias("__order"), F.col(key).alias("__key")).withColumn("__piece", piece)
    sizes = materialize(named.groupBy("__name", "__piece").agg(F.count(F.lit(1)).alias("__n")), "pieces")
    before = Window.partitionBy("__name").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__name", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))

    counts = sizes.groupBy(F.col("__name").alias("name")).agg(F.sum("__n").alias("n"))
    blocks = F.expr(f"(n + {block_rows - 1}) DIV {block_rows}")
    if targets is None:
        roots, most = counts.agg(F.sum(F.sqrt("n")), F.max(F.sqrt("n"))).first()
        # Whole units as fine as slots times units fit a long: the schedule ends before it shows.
        slots = ((most or 1) / block_rows + 1) * (roots or 1) + 2
        scale = min(2.0**30, max(1.0, 2.0**61 / (slots * (roots or 1))))
        share = F.greatest(F.lit(1), F.round(F.sqrt("n") * scale))
    else:
        listed = [F.lit(x) for s, u in targets.items() for x in ("=" + s, u)]
        share = F.coalesce(F.create_map(*listed)[F.col("name")], F.lit(1)) if listed else F.lit(1)
    units = materialize(counts.select("name", share.cast("long").alias("units"), blocks.alias("blocks")), "units")
    period, least = units.agg(F.sum("units"), F.min("units")).first()
    period, least = period or 1, least or 1
    last = units.agg(F.max(F.expr(f"(blocks * {period}L + units - 1) DIV units"))).first()[0] or 0
    # The schedule starts again after a period, which only given targets reach.
    pattern = schedule(units.select("name", "units"), min(last, period), period, -(-period // least))
    pattern = materialize(pattern.join(units, "name").where("nth < blocks").select("name", "nth", "slot"), "pattern")

    # The slots of a piece's blocks go as one array to its rows, which are not moved again. What grows
    # with the rows is met by shuffle and never broadcast.
    spans = offsets.join(sizes, ["__name", "__piece"]).join(units.toDF("__name", "__units", "__blocks"), "__name")
    spans = materialize(spans.withColumn("__first", F.expr(f"__before DIV {block_rows}")), "spans")
    each = spans.select(
        "__name", "__piece", "__units",
        F.explode(F.expr(f"sequence(__first, (__before + __n - 1) DIV {block_rows})")).alias("__block"),
    ).withColumn("nth", F.expr("__block % __units"))
    listed_slots = (
        each.join(pattern.withColumnRenamed("name", "__name").hint("merge"), ["__name", "nth"])
        .groupBy("__name", "__piece")
        .agg(F.sort_array(F.collect_list(F.struct("__block", F.expr(f"__block DIV __units * {period}L + slot").alias("slot")))).alias("__at"))
        .select("__name", "__piece", F.col("__at.slot").alias("__slots"))
    )
    spans = materialize(
        spans.join(listed_slots.hint("merge"), ["__name", "__piece"]).select("__name", "__piece", "__before", "__first", "__units", "__slots"),
        "slots",
    )

    rank = F.row_number().over(Window.partitionBy("__name", "__piece").orderBy("__order", "__key")) - 1
    placed = (
        named.withColumn("__rank", rank)
        .join(spans.hint("merge"), ["__name", "__piece"])
        .withColumn("__at", F.col("__before") + F.col("__rank"))
        .withColumn("block", F.expr(f"__at DIV {block_rows}"))
        .withColumn("__slot", F.expr("__slots[cast(block - __first as int)]"))
    )
    return placed.select(
        "__row.*",
        F.col("block"),
        F.expr(f"block * {period}L DIV __units").alias("release"),
        F.expr(f"((block + 1) * {period}L + __units - 1) DIV __units").alias("deadline"),
        F.col("__slot").alias("slot"),
        F.expr(f"__slot * {block_rows} + __at % {block_rows}").alias("position"),
    )
