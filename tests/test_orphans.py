from datetime import datetime

from pyspark.sql import functions as F

from tagloom import runtime
from tagloom.operators import orphans as O

T0, T1, T2 = datetime(2026, 1, 5), datetime(2026, 2, 5), datetime(2026, 3, 5)
PLAN = "id string, at timestamp_ntz, gone timestamp_ntz"
REF = "id string, at timestamp_ntz, ref string, kind string, status string"


def found(spark, refs, plan):
    r = O.references(spark.createDataFrame(refs, REF), "t", "ref", F.col("ref"), "id", "at", "k")
    return {(x.row_id, x.ref_key, x.status) for x in O.reference_status(r, O.parents(spark.createDataFrame(plan, PLAN), "k", "id", "at", "gone")).collect()}


def test_missing_deleted_late_and_living(spark):
    plan = [("a", T0, None), ("b", T0, T1), ("c", T2, None), ("d", T0, T1), ("d", T2, None), (None, T0, None)]
    refs = [("1", T1, " a\t", None, None), ("2", T1, "b", None, None), ("3", T1, "c", None, None), ("4", T1, "d", None, None), ("5", T1, "x", None, None), ("6", T1, " \t ", None, None), ("7", T1, None, None, None), ("8", None, "c", None, None)]
    assert found(spark, refs, plan) == {("1", "a", "living"), ("2", "b", "stale"), ("3", "c", "late"), ("4", "d", "late"), ("5", "x", "missing"), ("8", "c", "living")}


def test_lives_of_a_key(spark):
    """A key removed and made again: references of its first life are living, those between the lives late; touching and repeated intervals are one life."""
    d = [datetime(2026, 1, k) for k in range(1, 10)]
    plan = [("a", d[0], d[2]), ("a", d[0], d[2]), ("a", d[2], d[3]), ("a", d[5], None), ("b", d[1], d[2]), ("b", d[4], d[5]), ("c", None, d[3]), ("e", d[4], d[2])]
    refs = [("1", d[1], "a"), ("2", d[2], "a"), ("3", d[4], "a"), ("4", d[6], "a"), ("5", d[0], "b"), ("6", d[1], "b"), ("7", d[3], "b"), ("8", d[5], "b"), ("9", d[0], "c"), ("10", d[3], "c"), ("11", d[8], "e"), ("12", d[0], "e")]
    want = {("1", "a", "living"), ("2", "a", "living"), ("3", "a", "late"), ("4", "a", "living"), ("5", "b", "deleted"), ("6", "b", "deleted"), ("7", "b", "deleted"), ("8", "b", "stale"), ("9", "c", "deleted"), ("10", "c", "stale"), ("11", "e", "stale"), ("12", "e", "deleted")}
    assert found(spark, [(*r, None, None) for r in refs], plan) == want
    lives = O.validity(O.parents(spark.createDataFrame(plan, PLAN).repartition(3), "k", "id", "at", "gone"))
    assert {r.ref_key: [tuple(x) for x in r.lives] for r in lives.collect()}["a"] == [(d[0], d[3]), (d[5], None)]


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [("1", T0, "a", None, None)], []) == {("1", "a", "missing")}


def test_hot_key_and_repeated_rows(spark):
    refs = [(str(i % 50), T1, "hot" if i % 2 else f"k{i}", None, None) for i in range(400)]
    r = O.references(spark.createDataFrame(refs, REF), "t", "ref", F.col("ref"), "id", "at", "k")
    p = O.parents(spark.createDataFrame([("hot", T0, T1)], PLAN), "k", "id", "at", "gone")
    assert O.reference_status(r, p).count() == 400
    assert O.orphans(r, p).where("ref_key = 'hot'").count() == 25


def test_salted_join_equals_plain_join(spark):
    a = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    b = spark.range(0, 7, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi"):
        x, y = runtime.salted_join(a, b, ["k"], how), a.join(b, "k", how)
        assert sorted(map(tuple, x.select(sorted(x.columns)).collect()), key=repr) == sorted(map(tuple, y.select(sorted(y.columns)).collect()), key=repr)


def test_spread_leaves_shuffled_plans_alone(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert runtime.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = df.groupBy("id").count()
    assert runtime.spread(grouped) is grouped
