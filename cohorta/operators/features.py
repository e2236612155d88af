"""Feature preparation: flags, codes, group means, fills and column alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta import schema
from cohorta.functions.scalar import as_column, equals_flag, number_or_zero
from cohorta.operators.group_state import group_state, state_means
from cohorta.operators.slicing import number_rows
from cohorta.scratch import materialize

Flags = Mapping[str, Mapping[str, str]]


def rename_fields(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Applicant records to the column names used here."""
    return df.withColumnsRenamed(dict(names or schema.record_to_internal()))


def respell(df: DataFrame, aliases: Flags) -> DataFrame:
    """Replace the listed spellings of a column's values; others stay, absent columns are skipped."""
    present = {c: names for c, names in aliases.items() if c in df.columns and names}
    spelt = {
        c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), as_column(c)), as_column(c))
        for c, names in present.items()
    }
    return df.withColumns(spelt) if spelt else df


def one_hot(df: DataFrame, flags: Flags = schema.TREE_FLAGS, aliases: Flags | None = None) -> DataFrame:
    """0/1 columns for fixed values; the source column is dropped, absent ones skipped.

    Null and values outside the list give 0 everywhere.  ``aliases`` (none by default)
    maps other spellings to the listed ones first.
    """
    df = respell(df, aliases) if aliases else df
    for source, columns in flags.items():
        if source in df.columns:
            new = {name: equals_flag(source, value) for name, value in columns.items()}
            df = df.withColumns(new).drop(source)
    return df


def flag_with_fallback(
    df: DataFrame, source: str = "serie", value: str = "S1", fallback: str = "serie_s1", out: str = "s1"
) -> DataFrame:
    """Flag from the source column, or a copy of an existing flag when it is absent."""
    if source in df.columns:
        return df.withColumn(out, equals_flag(source, value))
    if fallback in df.columns:
        return df.withColumn(out, as_column(fallback))
    return df


def fill_nulls(df: DataFrame) -> DataFrame:
    """Fill every null with zero: the number 0, or the text ``0`` in text columns."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.fillna(0, numbers).fillna("0", texts)


def conform(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), prefix: str = ""
) -> DataFrame:
    """Exactly the listed features, in order, as numbers; missing columns are 0.

    ``keep`` lists further columns to carry along unchanged.
    """
    present = set(df.columns)
    columns = [
        (number_or_zero(df, f) if f in present else F.lit(0.0)).alias(prefix + f)
        for f in features
    ]
    return df.select(*[as_column(k) for k in keep], *columns)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail, before any job runs, when a required column is missing."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def group_mean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean per group; rows without a key value are left out."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*[as_column(k) for k in keys])
        .agg(F.avg(as_column(value)).alias(out))
    )


def map_group_mean(df: DataFrame, means: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Attach the mean of each row's group; null where key or group is unknown.

    ``means`` should be a stored table with one row per key.  Small ones then
    travel by broadcast, their size being known; else both sides of the join are
    plain shuffles, and adaptive execution splits the partition of a hot key.
    (Straight after an aggregation on the same key it could not.)
    """
    return df.join(means.select(*keys, out), list(keys), "left")


def target_mean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Target encoding: the mean of the row's own group."""
    return map_group_mean(df, stored_group_mean(df, keys, value, out), keys, out)


def stored_group_mean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Group means written to a table of their own."""
    return materialize(group_mean(df, keys, value, out), "means")


def cohort_prep(
    df: DataFrame,
    academy: str = "academie",
    residence: str = "residence",
    value: str = "moy_gle",
    cohort: str | None = None,
    flags: Flags = schema.COHORT_FLAGS,
    drop: Sequence[str] = ("mention",),
) -> DataFrame:
    """Cohort preparation: fill, flags, both group means, drops.

    Nulls are filled before grouping, so they form the group ``"0"``.  With a
    ``cohort`` column each cohort is prepared on its own.  Both means are learned
    in one pass over the rows as they come, not behind the join of the other.
    """
    df = one_hot(fill_nulls(df), flags)
    scope = [cohort] if cohort else []
    outs = {"academie_perf": academy, "residence_perf": residence}
    groupings = {out: [*scope, key] for out, key in outs.items() if key in df.columns and value in df.columns}
    if groupings:
        state = materialize(group_state(df, groupings, value), "group-state")
        for out, keys in groupings.items():
            df = map_group_mean(df, state_means(state, out, keys, out), keys, out).drop(outs[out])
    return df.drop(*drop)


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Code table ``(column_name, label, code)``: place among the sorted distinct texts.

    A null counts as the text ``nan``.  All columns are coded in one pass, and
    only distinct values are sorted, over as many tasks as the shuffle has.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), label_text(c).alias("label")) for c in columns
    ])
    values = df.select(F.inline(pairs)).distinct()
    numbered = number_rows(values, ["column_name", "label"], "__n")
    first = numbered.groupBy("column_name").agg(F.min("__n").alias("__first"))
    # One row per coded column.
    return numbered.join(F.broadcast(first), "column_name").select(
        "column_name", "label", (F.col("__n") - F.col("__first")).alias("code")
    )


def stored_label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The code table written once: every coded column reads it, and its size is known."""
    return materialize(label_codes(df, columns), "codes")


def label_text(column: str | Column) -> Column:
    return F.coalesce(as_column(column).cast("string"), F.lit("nan"))


def apply_label_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace texts by their codes; a text unknown to the table becomes null."""
    for name in columns:
        if name in df.columns:
            table = codes.where(F.col("column_name") == name).select(
                F.col("label").alias("__label"), F.col("code").alias("__code")
            )
            df = (
                df.withColumn("__label", label_text(name))
                .join(table, "__label", "left")
                .withColumn(name, F.col("__code"))
                .drop("__label", "__code")
            )
    return df


@dataclass(frozen=True)
class FeatureStats:
    """Statistics the features depend on, learned once and reused for any rows."""

    codes: DataFrame | None = None
    means: Mapping[str, DataFrame] = field(default_factory=dict)


def fit_feature_stats(
    df: DataFrame,
    value: str = "moy_gle",
    labels: Sequence[str] = schema.LABEL_COLUMNS,
    group_columns: Mapping[str, str] | None = None,
) -> FeatureStats:
    """Learn label codes and group means on a table of applicants."""
    groups = group_columns or {"academie_perf": "academie", "residence_perf": "residence"}
    present = [c for c in labels if c in df.columns]
    return FeatureStats(
        codes=stored_label_codes(df, present) if present else None,
        means={
            out: stored_group_mean(df, [key], value, out) for out, key in groups.items() if key in df.columns
        },
    )


def tree_features(
    df: DataFrame,
    stats: FeatureStats | None = None,
    features: Sequence[str] = schema.TREE_FEATURES,
    labels: Sequence[str] = schema.LABEL_COLUMNS,
    flags: Flags = schema.TREE_FLAGS,
    academy: str = "academie",
    value: str = "moy_gle",
    keep: Sequence[str] = (),
    prefix: str = "",
    aliases: Flags | None = None,
) -> DataFrame:
    """Inputs of the decision trees.

    With ``stats`` the codes and means learned on another table apply.  Without,
    every row is prepared on its own, as when applicants are scored one by one:
    each code is 0 and the academy mean is the applicant's own average.
    """
    kept = {k: f"__kept_{k}" for k in keep}
    df = df.withColumns({out: as_column(k) for k, out in kept.items()}) if kept else df
    df = one_hot(df, flags, aliases)
    present = [c for c in labels if c in df.columns]
    has_mean = academy in df.columns and value in df.columns
    if stats is None:
        if has_mean:
            df = df.withColumn("academie_perf", as_column(value))
        df = df.withColumns({c: F.lit(0) for c in present}) if present else df
    else:
        # Codes come first here, so a missing academy is a group of its own.
        if has_mean and "academie_perf" in stats.means and "academie_perf" in features:
            df = df.withColumn("__academy", label_text(academy))
            means = stats.means["academie_perf"].withColumnRenamed(academy, "__academy")
            df = map_group_mean(df, means, ["__academy"], "academie_perf").drop("__academy")
        if stats.codes is not None:
            df = apply_label_codes(df, stats.codes, [c for c in present if c in features])
    out = conform(df, features, list(kept.values()), prefix)
    return out.withColumnsRenamed({v: k for k, v in kept.items()})


def fit_tree_stats(
    df: DataFrame,
    value: str = "moy_gle",
    academy: str = "academie",
    labels: Sequence[str] = schema.LABEL_COLUMNS,
) -> FeatureStats:
    """Statistics for the trees: a missing academy has its own mean (and code)."""
    named = df.withColumn(academy, label_text(academy))
    return FeatureStats(
        codes=stored_label_codes(df, [c for c in labels if c in df.columns]),
        means={"academie_perf": stored_group_mean(named, [academy], value, "academie_perf")},
    )


def linear_features(
    df: DataFrame,
    features: Sequence[str],
    stats: FeatureStats | None = None,
    academy: str = "academie",
    residence: str = "residence",
    value: str = "moy_gle",
    keep: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """Inputs of a linear model: S1 flag, group means, then the listed features.

    Without ``stats`` a row is its own group.  A missing key gives a mean of 0.
    Means that are not among the features are not computed.
    """
    df = flag_with_fallback(df)
    for key, out in ((academy, "academie_perf"), (residence, "residence_perf")):
        if key not in df.columns or out not in features:
            continue
        if stats is None:
            df = df.withColumn(out, F.when(as_column(key).isNotNull(), as_column(value)))
        elif out in stats.means:
            df = map_group_mean(df, stats.means[out], [key], out)
    return conform(df, features, keep, prefix)


def baseline_prediction(df: DataFrame, source: str = "score_dap", out: str = "Score_Predit") -> DataFrame:
    """A column that is already there, taken as the prediction."""
    return df.withColumn(out, as_column(source))


def stack_cohorts(cohorts: Mapping[str, DataFrame], out: str = "cohort") -> DataFrame:
    """One frame of all cohorts, each row tagged; duplicates across cohorts stay."""
    stacked = None
    for name, df in cohorts.items():
        tagged = df.withColumn(out, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no cohorts given")
    return stacked
