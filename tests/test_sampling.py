from pyspark.sql import functions as F

from tagloom.operators import sampling as S


def rows(spark, n=200):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 5).cast("string").alias("src"), F.col("id").cast("double").alias("x"))


def test_layout_does_not_matter(spark):
    for f in (lambda d: S.bernoulli(d, "id", 0.2), lambda d: S.bottom_k(d, ["g"], "id", 4), lambda d: S.round_robin(d, "g", "src", "id", 7)):
        a, b = (sorted(r.id for r in f(rows(spark).repartition(n)).collect()) for n in (1, 7))
        assert a == b


def test_bernoulli_edges(spark):
    assert S.bernoulli(rows(spark), "id", 1).count() == 200
    assert S.bernoulli(rows(spark), "id", 0.0).count() == 0


def test_round_robin_takes_turns(spark):
    r = S.round_robin(rows(spark), "g", "src", "id", 10).groupBy("g", "src").count().collect()
    assert len(r) == 15 and {x["count"] for x in r} == {2}


def test_quantile_has_both_ends(spark):
    r = S.quantile_sample(rows(spark), "g", ["x"], 5).groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).collect()
    assert {(x.g, x.n) for x in r} == {("0", 5), ("1", 5), ("2", 5)} and {x.a for x in r} == {0.0, 1.0, 2.0} and {x.z for x in r} == {197.0, 198.0, 199.0}
    assert S.quantile_sample(rows(spark, 3), "g", ["x"], 5).count() == 3


def test_proportional_sums_up(spark):
    n = spark.createDataFrame([("a", 980), ("b", 15), ("c", 5), ("d", 0)], "k string, n long")
    got = {r.k: r.share for r in S.proportional(n, "k", "n", 100).collect()}
    assert sum(got.values()) == 100 and got["c"] >= 1 and "d" not in got


def test_batches(spark):
    d = spark.createDataFrame([("l", str(i), n) for i, n in enumerate([50, 60, 10, 200, 5, 5])], "l string, q string, n long")
    got = [r.batch for r in S.char_batches(d, "l", "q", "n", 3, 120).orderBy("q").collect()]
    assert got == [0, 0, 0, 1, 2, 2]


def test_greedy_prefers_rare(spark):
    d = spark.createDataFrame([(str(i), ["common"]) for i in range(10)] + [("r", ["rare", "common"]), ("e", []), ("n", None)], "id string, tags array<string>")
    picks = S.greedy_rare(d, "id", "tags", 3)
    assert picks[0] == "r" and len(set(picks)) == 3
