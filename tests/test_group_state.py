"""Group sums in one pass, merged states, and cohort preparation from them."""

import pytest

from cohorta.operators.features import cohort_prep, group_mean
from cohorta.operators.group_state import group_state, merge_states, state_means

ROWS = [
    ("1", "a", "x", 10.0), ("1", "a", "y", 20.0), ("1", None, "x", 30.0), ("2", "a", None, 40.0), ("2", "b", "y", None),
    ("2", "b", "z", 60.0), ("3", None, None, 70.0), ("3", "c", "z", float(2**40)),
]
SETS = {"k": ["k"], "l": ["l"], "both": ["c", "k"]}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "c string, k string, l string, v double")


def means(state, grouping, keys):
    return {tuple(r[k] for k in keys): r["m"] for r in state_means(state, grouping, keys, "m").collect()}


def test_state_gives_the_means_of_each_grouping(rows):
    state = group_state(rows, SETS, "v")
    for name, keys in SETS.items():
        want = {tuple(r[k] for k in keys): r["m"] for r in group_mean(rows.dropna(subset=["v"]), keys, "v", "m").collect()}
        assert means(state, name, keys) == want


def test_old_and_new_make_all(rows):
    parts = [group_state(rows.where(f"c = '{c}'"), SETS, "v") for c in "123"]
    nothing = group_state(rows.limit(0), SETS, "v")
    merged, whole = merge_states(*parts, nothing), group_state(rows, SETS, "v")
    assert sorted(map(str, merged.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_groupings_must_differ(rows):
    for sets in ({}, {"a": ["k", "l"], "b": ["l", "k"]}):
        with pytest.raises(ValueError, match="differ"):
            group_state(rows, sets, "v")


def test_cohort_prep_reads_its_rows_once_for_both_means(spark, rows):
    df = rows.select("c", "k", "l", "v").toDF("cohort", "academie", "residence", "moy_gle")
    got = cohort_prep(df, cohort="cohort", drop=()).collect()
    assert len(got) == len(ROWS)
    by = {}
    for c, k, l, v in ROWS:
        by.setdefault(("a", c, k or "0"), []).append(v or 0)
        by.setdefault(("r", c, l or "0"), []).append(v or 0)
    want = sorted((sum(by["a", c, k or "0"]) / len(by["a", c, k or "0"]), sum(by["r", c, l or "0"]) / len(by["r", c, l or "0"])) for c, k, l, _ in ROWS)
    assert sorted((r["academie_perf"], r["residence_perf"]) for r in got) == want
