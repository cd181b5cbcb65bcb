"""Queries that the test tables leave empty, on small tables that don't."""

from tagloom.operators import corpus as C
from tagloom.operators import repair as R
from tagloom.operators import votes as V

VOTES = "seq long, vote string, question_id string, error string, attempts int, choices array<struct<index:int,finish_reason:string,selected_label_ids:array<string>,parse_error:string>>"
PLAN = "question_id string, parent_stem string, child_question_ids array<string>, deleted_at timestamp_ntz"


def test_repeated_names_of_the_catalogue(spark, tmp_path):
    rows = [("1", "x", "a->x"), ("2", "x", "a->y"), ("2", None, "a->y"), ("3", None, None)]
    spark.createDataFrame(rows, "label_id string, label_name string, label_path string").write.parquet(f"{tmp_path}/label_catalog.parquet")
    assert {(r.field, r.value, r.n) for r in C.q_catalog_dups(spark, str(tmp_path)).collect()} == {("label_id", "2", 2), ("label_name", "x", 2), ("label_name", None, 2), ("label_path", "a->y", 2)}


def test_labels_that_only_the_parent_has(spark, tmp_path):
    one = lambda k, vote, q, *labels: (k, vote, q, None, 1, [(0, "stop", list(labels), None)])
    rows = [one(1, "qwen1", "p", "x", "y"), one(2, "qwen2", "p", "x", "y"), one(3, "qwen1", "c", "y"), one(4, "qwen2", "c", "y"), one(5, "qwen3", "c", "z"), one(6, "ds1", "p", "z")]
    spark.createDataFrame(rows, VOTES).write.parquet(f"{tmp_path}/vote_responses.parquet")
    spark.createDataFrame([("p", "s", ["c", None, "gone"], None)], PLAN).write.parquet(f"{tmp_path}/parent_plan.parquet")
    assert [(r.parent_id, r.label_id) for r in V.q_parent_extras(spark, str(tmp_path)).collect()] == [("p", "x")]


def test_every_status_of_an_orphan_parent(spark):
    source = "question_id string, parent_id string, stem string, options string, analysis string, image boolean"
    rows = [("a", "z", "t", "", "", False), ("b", "b", "t", "", "", True), ("c", "c", "", "A. x", "", True), ("d", "d", "", "", "", True), ("e", "e", "", "", "", False)]
    wanted = spark.createDataFrame([(k, 2) for k in "abcdef"], "parent_id string, children long")
    got = {r.parent_id: r.status for r in R.orphan_source(wanted, spark.createDataFrame(rows, source)).collect()}
    assert got == dict(zip("fabcde", R.STATUSES))


def test_every_action_of_a_repair(spark):
    units = spark.createDataFrame([("1", "p", "own"), ("2", "p", " "), ("3", "q", None), ("4", "r", None), ("5", "s", None), ("6", "t", None), ("7", "7", None), ("8", " ", None), ("9", "u", None)], "question_id string, parent_id string, parent_stem string")
    plan = spark.createDataFrame([("p", "plan"), ("q", "")], "parent_id string, plan_stem string")
    audit = spark.createDataFrame([("r", "found_with_text_stem", "src"), ("s", "found_image_only_stem", ""), ("t", "missing_from_original", "")], "parent_id string, status string, parent_stem string")
    got = {r.question_id: (r.action, r.parent_stem) for r in R.repaired_context(units, plan, audit).collect()}
    assert got == {"1": ("kept", "own"), "2": ("reconnected", "plan"), "3": ("wrapped", ""), "4": ("recovered", "src"), "5": ("wrapped", ""), "6": ("dropped", ""), "9": ("dropped", "")}


def test_filtered_rows(spark):
    q = "question_id string, parent_id string, body string"
    merged = spark.createDataFrame([("1", "p", "new"), ("2", "2", "b"), ("3", "3", "c"), ("p", "p", "parent")], q)
    first = spark.createDataFrame([("1", "p", "old"), ("2", "2", "b"), ("p", "p", "parent")], q)
    allowed = spark.createDataFrame([("1",), ("2",), ("2",)], "question_id string")
    got = sorted(map(tuple, R.filtered(merged, allowed, first).collect()))
    assert got == [("1", "p", "old", "restored"), ("2", "2", "b", "kept"), ("3", "3", "", "removed"), ("p", "p", "", "wrapper")]


def test_units_whatever_arrived_first(spark):
    source = spark.createDataFrame([("c1", "p", "x"), ("p", "p", "stem"), ("c2", "p", "y"), ("o", "gone", "z"), ("s", "s", "w")], "question_id string, parent_id string, stem string")
    units, plan = R.built_units(source)
    assert sorted(map(tuple, units.collect())) == [("c1", "p", "sub_question", "stem", 1), ("c2", "p", "sub_question", "stem", 1), ("o", "gone", "orphan_sub_question", "", 0), ("s", "s", "standalone", "", 0)]
    assert sorted(map(tuple, plan.collect())) == [("gone", "", 1, True), ("p", "stem", 2, False)]
    empty = [x.count() for x in R.built_units(source.where("1 = 0"))]
    assert empty == [0, 0]


def test_collisions_go_to_the_side(spark):
    a, b = (spark.createDataFrame(r, "k string, n int") for r in ([("1", 1), ("1", 2)], [("1", 3), ("2", 4)]))
    assert sorted(map(tuple, R.united(a, b, "k").collect())) == [("1", 1, "stream"), ("1", 2, "stream"), ("1", 3, "collision"), ("2", 4, "stream")]
