from pyspark.sql import functions as F

from tagloom.operators import retrieval as R
from tagloom.operators import votes as V


def votes(spark, rows):
    return spark.createDataFrame(rows, "question_id string, vote string, labels array<string>")


def test_latest_success_ignores_errors(spark):
    log = spark.createDataFrame([("k", 1, None, "a"), ("k", 2, None, "b"), ("k", 3, "boom", "c"), ("m", 1, "boom", "d")], "k string, seq long, error string, v string")
    assert [(r.k, r.v) for r in V.latest_success(log, ["k"], "seq", "error is null").collect()] == [("k", "b")]
    assert sorted((r.k, r.v, r.success) for r in V.prefer_success(log, ["k"], "seq", "error is null").collect()) == [("k", "b", True), ("m", "d", False)]


def test_cube_of_two_questions(spark):
    six = lambda q, sel: [(q, v, sel.get(v, [])) for v in V.QWEN + V.DS]
    v = votes(spark, six("1", {**{x: ["a"] for x in V.QWEN + V.DS}, "qwen1": ["a", "b"]}) + six("2", {**{x: ["a"] for x in V.QWEN}, "ds1": ["b"]}) + [("3", "qwen1", ["a"])])
    seen = spark.createDataFrame([(q, x, i + 1) for q in "123" for i, x in enumerate("abc")], "question_id string, label_id string, rk int")
    cells = {(r.q, r.d): r["count"] for r in V.vote_cube(v, seen).groupBy("q", "d").count().collect()}
    assert cells == {(3, 3): 1, (1, 0): 1, (3, 0): 1, (0, 1): 1, (0, 0): 2}


def test_missing_vote_is_not_negative(spark):
    v = votes(spark, [("1", "qwen1", ["a"]), ("1", "qwen2", ["a"]), ("2", "qwen1", ["a"]), ("2", "qwen2", [])])
    got = {(r.question_id, r.label_id): r.kept for r in V.strict_intersection(v, V.QWEN).collect()}
    assert got == {("1", "a"): True, ("2", "a"): False}


def test_quota_fusion_stages(spark):
    one = lambda ids: spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(ids)], "question_id string, label_id string, rk int")
    got = [(r.label_id, r.stage) for r in R.quota_fuse(one("abcdef"), one("bxycz"), 3, 2, 7).orderBy("rk").collect()]
    assert got[:5] == [("a", 1), ("b", 1), ("c", 1), ("x", 2), ("y", 2)] and {s for _, s in got[5:]} == {3} and len(got) == 7


def test_bm25_paths_agree(spark):
    labels = spark.createDataFrame([(str(i), f"细胞{i}", "A->B", "光合作用" * (i + 1), "", None, "dna") for i in range(4)], "label_id string, label_name string, label_path string, definition string, core_concepts string, common_assessments string, distinctions string")
    units = spark.createDataFrame([("u", "细胞2的光合作用", None, "DNA", None, None), ("v", None, None, None, None, None)], "question_id string, stem string, answer_text string, analysis string, options string, parent_stem string")
    a = sorted(map(tuple, R.bm25_topk(units, labels, 3).collect()))
    assert a == sorted(map(tuple, R.bm25_join(units, R.bm25_index(labels), 3).collect())) and [r[1] for r in a if r[3] == 1] == ["2"] and {r[0] for r in a} == {"u"}


def test_recall(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 4)], "question_id string, label_id string, rk int")
    t = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "a")], "question_id string, label_id string")
    got = {r.k: (r.questions, r.any_hit, r.all_hit, r.target_hits) for r in R.recall_at(ranked, t, [1, 5]).collect()}
    assert got == {1: (2, 0, 0, 0), 5: (2, 1, 0, 1)}


def test_cosine_is_exact(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(12)], "vec_id long, embedding array<double>")
    got = R.cosine_topk(v, v.where(F.col("vec_id") == 3), k=2).collect()
    assert [r.rk for r in got] == [1, 2] and all(r.vec_id != 3 for r in got)


def test_cosine_ignores_nulls(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.similarity) for r in R.cosine_topk(v, v.where("vec_id = 1 or vec_id is null"), k=5).orderBy("rk").collect()]
    assert got == [(1, 2, 0.995037), (1, 5, 0.0)]
    assert R.cosine_topk(v.where("vec_id > 9"), v.where("vec_id > 9")).count() == 0
