import pytest
from pyspark.sql import functions as F

from cohorta import schema
from cohorta.functions.scalar import number_or_zero, parse_number, rounded
from cohorta.operators import features as P


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_one_hot_unknown_null_and_absent(spark):
    df = spark.createDataFrame([(1, "F"), (2, None), (3, "X")], "id int, sexe string")
    out = P.one_hot(df)
    assert out.columns == ["id", "sexe_f", "sexe_m"]
    assert [(r["sexe_f"], r["sexe_m"]) for r in out.orderBy("id").collect()] == [(1, 0), (0, 0), (0, 0)]


def test_spelling_of_the_levels_matters(spark):
    df = spark.createDataFrame([("Pass",), ("Passable",)], "mention string")
    assert [r["mention_pass"] for r in P.one_hot(df).collect()] == [0, 1]


def test_flag_fallback(spark):
    df = spark.createDataFrame([("S1", 0)], "serie string, serie_s1 int")
    assert P.flag_with_fallback(df).first()["s1"] == 1
    assert P.flag_with_fallback(df.drop("serie")).first()["s1"] == 0
    assert "s1" not in P.flag_with_fallback(df.select(F.lit(1).alias("x"))).columns


def test_fill_nulls_covers_text_and_numbers(spark):
    df = spark.createDataFrame([(None, None, None)], "a string, b double, c int")
    assert rows(P.fill_nulls(df)) == [{"a": "0", "b": 0.0, "c": 0}]


@pytest.mark.parametrize("text, value", [
    (" 12.5 ", 12.5), ("x", None), ("", None), ("1d", None), ("2.5f", None), ("0x10", None), ("1e3", 1000.0), ("-3", -3.0),
])
def test_parse_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_number("t")).first()[0] == value
    assert df.select(number_or_zero(df, "t")).first()[0] == (value or 0.0)


def test_numbers_that_are_missing_become_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(number_or_zero(df, "x")).collect()] == [0.0, 0.0, 2.0]


@pytest.mark.parametrize("value, digits, want", [(0.125, 2, 0.12), (7.855, 2, 7.86), (-1.5, 0, -2.0), (None, 2, None)])
def test_rounded(spark, value, digits, want):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(rounded(F.col("x"), digits)).first()[0] == want


def test_conform_order_and_missing(spark):
    df = spark.createDataFrame([("7", 2.0, 9)], "b string, a double, id int")
    out = P.conform(df, ["a", "zz", "b"], keep=["id"])
    assert out.columns == ["id", "a", "zz", "b"]
    assert tuple(out.first()) == (9, 2.0, 0.0, 7.0)


def test_require_columns_fails_before_running(spark):
    with pytest.raises(ValueError, match="nope"):
        P.require_columns(spark.range(1), ["id", "nope"])


def test_columns_with_dots_and_quotes(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", 20.0)], "`Académie de l'Ets. Prov.` string, `Moy. Gle` double")
    names = schema.file_to_internal()
    out = P.target_mean(P.rename_fields(df, names), ["academie"], "moy_gle", "academie_perf")
    assert [r["academie_perf"] for r in out.collect()] == [15.0, 15.0]


def test_group_mean_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "k string, v double")
    assert {r["k"]: r["m"] for r in P.target_mean(df, ["k"], "v", "m").collect()} == {"a": 2.0, None: None}


def test_cohort_prep_null_groups_and_drops(spark):
    df = spark.createDataFrame(
        [(1, "A", None, 10.0, "S1", "M", "Bien"), (2, None, "r", 20.0, None, "F", None), (3, None, "r", 40.0, "S3", None, "x")],
        "row_id long, academie string, residence string, moy_gle double, serie string, sexe string, mention string",
    )
    got = {r["row_id"]: r for r in P.cohort_prep(df).collect()}
    assert [got[i]["academie_perf"] for i in (1, 2, 3)] == [10.0, 30.0, 30.0]
    assert [got[i]["residence_perf"] for i in (1, 2, 3)] == [10.0, 30.0, 30.0]
    assert (got[1]["s1"], got[2]["s1"], got[3]["s3"], got[1]["homme"], got[2]["femme"]) == (1, 0, 1, 1, 1)
    assert not {"academie", "residence", "mention", "serie", "sexe"} & set(got[1].asDict())


def test_cohort_prep_without_optional_columns(spark):
    df = spark.createDataFrame([(1, None)], "row_id long, x double")
    assert rows(P.cohort_prep(df)) == [{"row_id": 1, "x": 0.0}]


def test_label_codes_sorted_with_null_as_text(spark):
    df = spark.createDataFrame([("b", "x"), (None, "x"), ("a", "y"), ("z", "x")], "u string, v string")
    codes = {(r["column_name"], r["label"]): r["code"] for r in P.label_codes(df, ["u", "v"]).collect()}
    assert codes == {("u", "a"): 0, ("u", "b"): 1, ("u", "nan"): 2, ("u", "z"): 3, ("v", "x"): 0, ("v", "y"): 1}


def test_tree_features_of_rows_on_their_own(spark):
    df = spark.createDataFrame(
        [(1, "R", "A", 12.0, "F"), (2, "Q", None, 8.0, "M")],
        "row_id long, residence string, academie string, moy_gle double, sexe string",
    )
    out = P.tree_features(df, keep=["row_id"])
    assert out.columns == ["row_id", *schema.TREE_FEATURES]
    got = {r["row_id"]: r for r in out.collect()}
    assert [got[i]["academie_perf"] for i in (1, 2)] == [12.0, 8.0]
    assert [got[i]["residence"] for i in (1, 2)] == [0.0, 0.0]
    assert (got[1]["sexe_f"], got[2]["sexe_m"], got[1]["math"]) == (1.0, 1.0, 0.0)


def test_tree_features_with_learned_statistics(spark):
    learned = spark.createDataFrame(
        [("A", 10.0, "x"), ("A", 20.0, "y"), (None, 30.0, "x")], "academie string, moy_gle double, centre string"
    )
    new = spark.createDataFrame(
        [(1, "A", 0.0, "y"), (2, None, 0.0, "x"), (3, "unseen", 0.0, "unseen")],
        "row_id long, academie string, moy_gle double, centre string",
    )
    got = {r["row_id"]: r for r in P.tree_features(new, P.fit_tree_stats(learned), keep=["row_id"]).collect()}
    # A missing academy is a group of its own here; an unseen one has no mean and no code.
    assert [got[i]["academie_perf"] for i in (1, 2, 3)] == [15.0, 30.0, 0.0]
    assert [got[i]["academie"] for i in (1, 2, 3)] == [0.0, 1.0, 0.0]
    assert [got[i]["centre"] for i in (1, 2, 3)] == [1.0, 0.0, 0.0]


def test_linear_features_scopes(spark):
    df = spark.createDataFrame(
        [(1, "A", "r", 10.0, "S1"), (2, "A", None, 20.0, "S2")],
        "row_id long, academie string, residence string, moy_gle double, serie string",
    )
    wanted = ["s1", "residence_perf", "academie_perf", "absent"]
    own = {r["row_id"]: tuple(r)[1:] for r in P.linear_features(df, wanted, keep=["row_id"]).collect()}
    assert own == {1: (1.0, 10.0, 10.0, 0.0), 2: (0.0, 0.0, 20.0, 0.0)}
    stats = P.fit_feature_stats(df, labels=())
    learned = {r["row_id"]: tuple(r)[1:] for r in P.linear_features(df, wanted, stats, keep=["row_id"]).collect()}
    assert learned == {1: (1.0, 10.0, 15.0, 0.0), 2: (0.0, 0.0, 15.0, 0.0)}


def test_stack_keeps_duplicates(spark):
    df = spark.createDataFrame([(1,)], "row_id long")
    assert P.stack_cohorts({"a": df, "b": df}).count() == 2
    with pytest.raises(ValueError):
        P.stack_cohorts({})


def test_other_spellings_only_where_asked_for(spark):
    df = spark.createDataFrame([(1, "Pass"), (2, "Passable"), (3, "ABien"), (4, None), (5, "x")], "id long, mention string")
    flags = ["mention_pass", "mention_abien", "mention_bien"]

    def found(out):
        return {r["id"]: [r[f] for f in flags] for r in out.collect()}

    plain, spelt = P.one_hot(df), P.one_hot(df, aliases=schema.MENTION_ALIASES)
    assert found(plain) == {1: [0, 0, 0], 2: [1, 0, 0], 3: [0, 0, 0], 4: [0, 0, 0], 5: [0, 0, 0]}
    assert found(spelt) == {1: [1, 0, 0], 2: [1, 0, 0], 3: [0, 1, 0], 4: [0, 0, 0], 5: [0, 0, 0]}
    assert P.respell(df, {"absent": {"a": "b"}, "mention": {}}).collect() == df.collect()
