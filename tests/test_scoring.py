import pytest
from pyspark.sql import functions as F

from cohorta.functions import scalar as S
from cohorta.operators import scoring as M
from cohorta.plans import predict
from cohorta.sources import models, records, tables

TERMS = (M.Term("x", 2.0, 10.0, 5.0), M.Term("y", 1.0))
CASCADE = M.Cascade(
    {"admission": M.Split("x", 5.0, 0, 1), "session": M.Split("y", 0.0, 0, 1),
     "mention": M.Split("x", 8.0, 0, M.Split("y", 100.0, 1, 0))},
    {k: M.LinearModel(b, TERMS) for k, b in (("non_admi", 0.0), ("deuxieme_session", 1.0), ("passable", 2.0), ("mention", 3.0))},
)


@pytest.fixture(scope="module")
def applicants(spark):
    data = [(1, 5.0, 9.0), (2, 6.0, 0.0), (3, 8.0, 1.0), (4, 9.0, 100.0), (5, 9.0, 101.0)]
    return spark.createDataFrame(data, "row_id long, x double, y double")


def test_routes_at_the_thresholds(applicants):
    out = {r["row_id"]: r for r in M.score_batch(applicants, CASCADE).collect()}
    assert [out[i]["Model_Utilise"] for i in range(1, 6)] == ["non_admi", "deuxieme_session", "passable", "mention", "passable"]
    assert out[1]["Prediction_Status"] == "NON ADMIS"
    assert out[4]["Prediction_Status"] == "MENTION SUPÉRIEURE"
    assert out[4]["Score_Predit"] == pytest.approx(3.0 + 2.0 * (9 - 10) / 5 + 100.0)


def test_missing_model_and_missing_value_become_errors(applicants):
    partial = M.Cascade(CASCADE.trees, {"non_admi": CASCADE.models["non_admi"], "mention": CASCADE.models["mention"]})
    holes = applicants.withColumn("y", F.when(F.col("row_id") != 4, F.col("y")))
    out = {r["row_id"]: tuple(r)[3:] for r in M.score_batch(holes, partial, required=["y"]).collect()}
    assert out[2] == ("ERREUR", None, None)
    assert out[4] == ("ERREUR", None, None)
    assert out[1][0] == "NON ADMIS"


def test_no_models_at_all(applicants):
    assert {r["Prediction_Status"] for r in M.score_batch(applicants, M.Cascade(CASCADE.trees, {})).collect()} == {"ERREUR"}


def test_missing_tree_is_fatal():
    with pytest.raises(ValueError, match="mention"):
        M.Cascade({"admission": 0, "session": 1}, {})


def test_scoring_is_one_projection(applicants):
    plan = M.score_batch(applicants, CASCADE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_shift_keeps_other_statuses(spark):
    df = spark.createDataFrame(
        [("PASSABLE", 1.0), ("NON ADMIS", 1.0), ("ERREUR", None)], "Prediction_Status string, Score_Predit double"
    )
    assert [r["Score_Predit"] for r in M.adjust_by_status(df).collect()] == [-4999.0, 1.0, None]


def test_global_model_needs_its_columns(applicants):
    model = M.LinearModel(1.0, (M.Term("x", 1.0), M.Term("q", 1.0)))
    with pytest.raises(ValueError, match="q"):
        M.global_linear_score(applicants, model)


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_model_table_joined_or_broadcast(spark, size):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0)], "cohort string, x double, y double")
    table = spark.createDataFrame(
        [("a", "x", 2.0, 0.0, 1.0, 5.0), ("a", "y", 1.0, 1.0, 2.0, 5.0), ("b", "y", 10.0, 0.0, 1.0, 0.0)],
        "cohort string, feature string, coef double, mean double, scale double, intercept double",
    )
    out = M.score_with_model_table(df, table, ["x", "y"], ["cohort"], max_broadcast_bytes=size)
    assert out.columns == ["cohort", "x", "y", "Score_Predit"]
    assert {r["cohort"]: r["Score_Predit"] for r in out.collect()} == {"a": 7.5, "b": 20.0, "c": None}


def test_parameters_survive_the_tables(spark, tmp_path):
    folder = str(tmp_path / "m")
    tables.write_model_tables(models.linear_table(spark, CASCADE.models), models.tree_table(spark, CASCADE.trees), folder)
    assert models.load_cascade(spark, folder) == CASCADE


def test_missing_model_in_the_tables_is_reported(spark, tmp_path):
    folder = str(tmp_path / "m")
    partial = {"mention": CASCADE.models["mention"]}
    tables.write_model_tables(models.linear_table(spark, partial), models.tree_table(spark, CASCADE.trees), folder)
    with pytest.warns(UserWarning, match="non_admi"):
        assert set(models.load_cascade(spark, folder).models) == {"mention"}
    no_tree = {k: v for k, v in CASCADE.trees.items() if k != "session"}
    tables.write_model_tables(models.linear_table(spark, partial), models.tree_table(spark, no_tree), str(tmp_path / "n"))
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="session"):
        models.load_cascade(spark, str(tmp_path / "n"))


@pytest.mark.parametrize("p, v1, orientation, success", [
    (95.0, 0, 0, 0), (94.99, 0, 0, 1), (75.0, 0, 0, 1), (74.99, 1, 1, 1), (70.0, 1, 1, 1), (69.9, 1, 1, 2),
    (50.0, 1, 1, 2), (49.9, 2, 2, 3), (25.0, 2, 2, 3), (24.9, 3, 3, 3), (10.0, 3, 3, 3), (9.99, 3, 3, 4), (-1.0, 3, 3, 4),
])
def test_bands(spark, p, v1, orientation, success):
    df = spark.createDataFrame([(p,)], "p double")
    row = df.select(S.advice_v1("p"), S.advice_v2("p", "orientation"), S.advice_v2("p", "success")).first()
    assert row[0] == S.ADVICE_V1[v1][1]
    assert row[1] == S.ADVICE_ORIENTATION[orientation][1]
    assert row[2] == S.ADVICE_SUCCESS[success][1]


def test_unknown_kind_and_null_probability(spark):
    df = spark.createDataFrame([(None,)], "p double")
    row = df.select(S.advice_v2("p", "other"), S.advice_v1("p")).first()
    assert tuple(row) == (S.ADVICE_UNKNOWN_KIND, None)


def scored(spark, *rows):
    return spark.createDataFrame(
        list(rows), "row_id long, Prediction_Status string, Score_Predit double, Model_Utilise string, mention string, serie string"
    )


def test_first_probability_caps_and_bonuses(spark):
    df = scored(
        spark,
        (1, "MENTION SUPÉRIEURE", 500.0, "mention", "Bien", "S1"),
        (2, "PASSABLE", 60.0, "passable", "Bien", "S1"),
        (3, "ERREUR", None, None, "Bien", "S1"),
        (4, "NON ADMIS", -12.0, "non_admi", None, None),
    )
    got = {r["row_id"]: r for r in predict.success_probability_v1(df).collect()}
    assert (got[1]["probability"], got[1]["normalised_score"], got[1]["score_percentage"]) == (95.0, 20.0, 100.0)
    assert (got[2]["probability"], got[2]["mention_bonus"]) == (37.5, 0.0)
    assert got[3]["probability"] is None and got[3]["base_probability"] == 0.0
    assert got[4]["probability"] == -1.0
    boosted = {r["row_id"]: r for r in predict.success_probability_v1(df, bonuses=True).collect()}
    assert (boosted[2]["probability"], boosted[2]["mention_bonus"], boosted[2]["serie_bonus"]) == (46.0, 10.0, 7.0)


def test_second_probability_and_misses(spark):
    df = scored(
        spark,
        (1, "MENTION SUPÉRIEURE", 50.0, "mention", None, None),
        (2, "NON ADMIS", 1.0, "non_admi", None, None),
        (3, "ERREUR", None, None, None, None),
    )
    ranks = spark.createDataFrame([(10.0, 200), (40.0, 80)], "score double, rank long")
    got = {r["row_id"]: r for r in predict.predict_v2(df, ranks, "row_id", keep=["row_id"]).collect()}
    assert (got[1]["orientation_probability"], got[1]["success_probability"]) == (90.0, 95.0)
    # Below the whole table the rank is 0, hence 100 percent.
    assert (got[2]["orientation_probability"], got[2]["success_probability"]) == (100.0, 10.0)
    assert (got[3]["score"], got[3]["orientation_probability"], got[3]["success_probability"]) == (None, None, 0.0)
    assert got[3]["orientation_probability_message"] is None


def test_first_response_and_batch_shape(spark):
    df = scored(spark, (1, "PASSABLE", 60.0, "passable", "Bien", "S1"))
    row = predict.predict_v1(df).first()
    assert row["details"] == {"score_percentage": 50.0, "base_probability": 75.0, "mention_bonus": 0.0, "serie_bonus": 0.0}
    assert row["recommendation"] == S.ADVICE_V1[2][1]
    nested = predict.predict_batch(df, ["row_id", "serie"]).first()
    assert nested["student"].asDict() == {"row_id": 1, "serie": "S1"}
    assert nested["prediction"]["probability"] == 37.5


RECORD = {
    "Sexe": "F", "Série": "S2", "Age_en_Décembre_2018": 19, "MATH": 12.0, "SCPH": 11.0, "FR": 10.0, "PHILO": 9.0,
    "AN": 14.0, "Moy_nde": 12.0, "Moy_ère": 12.5, "Moy_S_Term": 13.0, "Moy_S_Term_1": 12.8, "Moy_Gle": 12.2,
    "Moy_sur_Mat_Fond": 11.9, "Année_BAC": 2018, "Nbre_Fois_au_BAC": 1, "Mention": "Passable", "Groupe_Résultat": 1,
    "Tot_Pts_au_Grp": 250, "Moyenne_au_Grp": 12.1, "Résidence": "R", "Ets_de_provenance": "E", "Centre_Ec": "C",
    "Académie_de_Ets_Prov": "A", "REGION_DE_NAISSANCE": "N",
}


def test_single_record_to_prediction(spark):
    valid, rejected = records.split_valid(records.records_frame(spark, [RECORD, {**RECORD, "MATH": None, "Sexe": None}]))
    assert rejected.first()["missing"] == ["Sexe", "MATH"]
    assert len(valid.columns) == 25
    cascade = M.Cascade(
        {"admission": M.Split("sexe_f", 0.5, 0, 1), "session": M.Split("academie_perf", 12.0, 0, 1), "mention": 0},
        {"passable": M.LinearModel(1.0, (M.Term("math", 2.0), M.Term("residence_perf", 1.0), M.Term("s1", 100.0)))},
    )
    row = predict.score_applicants(valid, cascade, digits=4).first()
    assert (row["Prediction_Status"], row["Score_Predit"], row["Model_Utilise"]) == ("PASSABLE", 37.2, "passable")


def test_null_and_nan_inputs_are_errors(spark):
    cascade = M.Cascade(
        {"admission": M.Split("a", 1.0, 0, 1), "session": M.Split("b", 1.0, 0, 1), "mention": 1},
        {"non_admi": M.LinearModel(1.0, (M.Term("c", 1.0),)), "mention": M.LinearModel(2.0, (M.Term("a", 1.0, 0.0, 0.0),))},
    )
    nan = float("nan")
    rows = [(1, None, 2.0, 0.0), (2, nan, 2.0, 0.0), (3, 0.0, None, 5.0), (4, 0.0, nan, None), (5, 0.0, 0.0, nan), (6, 3.0, nan, 0.0), (7, 3.0, 2.0, None)]
    out = M.score_batch(spark.createDataFrame(rows, "id long, a double, b double, c double"), cascade).orderBy("id")
    got = [(r["id"], r["Prediction_Status"], r["Score_Predit"], r["Model_Utilise"]) for r in out.collect()]
    bad = ("ERREUR", None, None)
    # Only what the row's own way needs counts: row 3 lacks a value that no one asks for, as does row 7.
    assert got == [(1, *bad), (2, *bad), (3, "NON ADMIS", 6.0, "non_admi"), (4, *bad), (5, *bad), (6, *bad),
                   (7, "MENTION SUPÉRIEURE", 5.0, "mention")]
