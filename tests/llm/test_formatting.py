import re

from tagloom.llm import formatting as M
from tagloom.llm.canon import alnum, line_set

SCHEMA = "question_id string, stem string, answer_text string, options string, h64 string"


def keys(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return M.keyed(df, "question_id", [alnum("stem"), alnum("answer_text"), line_set("options")], alnum("stem"))


def test_formatting_is_ignored(spark):
    rows = [("1", "Ab C。", "x", "A. 1\nB. 2"), ("2", " abc ", "X!", "B. 2\n\nA. 1"), ("3", "abc", "x", "A. 1\nA. 1\nB. 2"), ("4", "ab", "cx", "A. 1\nB. 2"), ("5", None, None, None), ("6", "!!", "x", None), ("7", "z", None, None), ("8", "Z", "", "\n")]
    k = keys(spark, rows)
    assert sorted(map(tuple, M.copies(k, "question_id").collect())) == [("1", "2"), ("7", "8")]
    assert sorted((r.keep_id, r.n_copies) for r in M.copy_groups(k, "question_id").collect()) == [("1", 2), ("3", 1), ("4", 1), ("7", 2)]


def test_fields_do_not_run_together(spark):
    assert M.copies(keys(spark, [("1", "ab", "c", ""), ("2", "a", "bc", "")]), "question_id").count() == 0


def test_hot_group_and_repeated_rows(spark):
    rows = [(f"{i:04d}", "same", "a", None) for i in range(800)] + [("0000", "same", "a", None), *((f"x{i}", f"t{i}", "", None) for i in range(200))]
    c = M.copies(keys(spark, rows), "question_id").distinct().collect()
    assert len(c) == 799 and {r.keep_id for r in c} == {"0000"}


def test_brute_force(spark, duck):
    rows = duck.sql("select question_id, stem, answer_text, options from label_units").fetchall()
    low = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    groups = {}
    for q, s, a, o in rows:
        if low(s):
            groups.setdefault((low(s), low(a), tuple(sorted(filter(None, map(low, re.split(r"\r\n|\n|\r", o or "")))))), []).append(q)
    want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert want and sorted(map(tuple, M.copies(keys(spark, rows), "question_id").collect())) == want


def test_empty_and_long(spark):
    assert M.copies(keys(spark, []), "question_id").count() == 0
    assert M.copies(keys(spark, [("1", "Ж" * 200_000, "", ""), ("2", "ж " * 200_000, "", "")]), "question_id").count() == 1
