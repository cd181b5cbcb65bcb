import pytest
from pyspark.sql import functions as F

from tagloom.operators import review as R


def test_co_label_decisions(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (True, False, True), (False, False, True), (True, True, False), (True, True, None)], "t boolean, s boolean, ok boolean")
    got = [r[0] for r in df.select(R.co_label_decision(F.col("t"), F.col("s"), F.col("ok"))).collect()]
    assert got == ["reasonable_co_label", "target_too_broad", "source_insufficient", "neither_sufficient", "unresolved", "unresolved"]


def test_corrected_rate_is_null_without_tasks(spark):
    df = spark.createDataFrame([("a", 1, 9), ("b", 0, 0)], "target_id string, target_too_broad long, rejected long")
    assert [(r.corrected, r.tier) for r in R.corrected_screen(df).orderBy("target_id").collect()] == [(0.1, "moderate"), (None, None)]


def test_within_choices(spark):
    schema = "question_id string, vote string, seq long, error string, choices array<struct<selected_label_ids:array<string>,parse_error:string>>"
    log = spark.createDataFrame([("q", "a", 1, None, [(["x"], None), (["x", "x", None], None), (["y"], None), (["z"], "bad")]), ("q", "a", 2, "boom", [(["x"], None)]), ("q", "b", 3, None, [(None, None)]), ("q", "c", 4, None, None)], schema)
    assert sorted((r.vote, r.n, r.forms, r.mean_jaccard) for r in R.within_choices(log).collect()) == [("a", 3, 2, round(1 / 3, 6)), ("b", 1, 1, None)]


def test_signature_does_not_depend_on_order(spark):
    a = spark.createDataFrame([("q", "1"), ("q", "2"), ("r", "1")], "question_id string, label_id string")
    one = {r.question_id: r.signature for r in R.candidate_signature(a, "s").collect()}
    two = {r.question_id: r.signature for r in R.candidate_signature(a.orderBy(F.desc("label_id")).repartition(3), "s").collect()}
    assert one == two and one["q"] != one["r"]


def test_frozen_inputs(spark, tmp_path):
    df = spark.range(5).selectExpr("cast(id as string) id")
    assert R.frozen(df, f"{tmp_path}/stage").count() == 5
    assert R.frozen(df.repartition(3), f"{tmp_path}/stage").count() == 5
    with pytest.raises(ValueError):
        R.frozen(df.limit(3), f"{tmp_path}/stage")


def test_recover(spark):
    snap = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "k string, v string")
    assert [r.v for r in R.recover(spark.createDataFrame([("1",), ("1",)], "k string"), snap, "k").collect()] == ["a"]
    for keys in (["3"], ["2"]):
        with pytest.raises(ValueError):
            R.recover(spark.createDataFrame([(k,) for k in keys], "k string"), snap, "k")
