import random

from tagloom.llm.topn import top_n


def expected(rows, n):
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), float("-inf")), s)
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i))
    return sorted(((g, i, k) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n], 1)), key=repr)


def run(spark, rows, n=5, parts=6):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, item string, s double, position string, _pid int").repartition(parts)
    return sorted(((r.g, r.item, r.position) for r in top_n(df, "g", "s", "item", n).collect()), key=repr)


def test_brute_force_with_hot_group_ties_and_dirt(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 5 + [None, "", *map(str, range(40))]), rnd.choice([None, *map(str, range(300))]), rnd.choice([None, float("nan"), 0.0, -0.0, 0.5, 0.5, rnd.random(), float("inf")])) for _ in range(6000)]
    rows += rows[:500]
    for conf in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert run(spark, rows) == expected(rows, 5)
            assert run(spark, rows, 40) == expected(rows, 40)  # groups whose N lie over several partitions
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_and_one_group(spark):
    rows = [("only", f"{i:05d}", float(i % 7)) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert run(spark, rows, 200) == expected(rows, 200)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("g", None, 1.0)]) == []
