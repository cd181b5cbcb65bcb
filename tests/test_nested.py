import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.operators import nested as N


def flat(spark, texts, skip=N.NO_VALUE):
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "id string, a string, leaf_path string")
    return sorted((r.id, r.leaf_path, r.leaf_value) for r in N.flatten_json(df, "a", ["id"], skip).collect())


def test_shapes(spark):
    texts = [None, "  ", " C ", '"[\\"A\\"]"', '{"answers": ["B", null, "C"], "score": 3}', '[["x", false], {"answers": [["y"], "z"]}]', "[1, 2", '{"a":1} x', "[1]]", '{"a":1},"b":2', '"plain"', "[]", '["  ", 0.5, true]', '{"a": "1", "a": "2"}']
    assert flat(spark, texts) == sorted([
        ("2", "$", "C"), ("3", "$/0", "A"), ("4", "$/answers/0", "B"), ("4", "$/answers/2", "C"), ("5", "$/0/0", "x"), ("5", "$/0/1", "false"), ("5", "$/1/answers/0/0", "y"), ("5", "$/1/answers/1", "z"), ("10", "$", "plain"), ("12", "$/1", "0.5"), ("12", "$/2", "true"), ("13", "$/a", "2")])


def test_no_depth_is_cut(spark):
    deep = '{"k":' * 30 + '["v"]' + "}" * 30
    assert flat(spark, [deep, "[]"]) == [("0", "$" + "/k" * 30 + "/0", "v")]


def test_empty_table(spark):
    assert flat(spark, []) == []


def test_long_text(spark):
    assert len(flat(spark, [json.dumps(["v"] * 20_000)])) == 20_000


def leaves(v, path="$"):
    if isinstance(v, dict):
        return [x for k, y in v.items() if k not in N.NO_VALUE for x in leaves(y, f"{path}/{k}")]
    if isinstance(v, list):
        return [x for k, y in enumerate(v) for x in leaves(y, f"{path}/{k}")]
    return [] if v is None or isinstance(v, str) and not v.strip() else [path]


KEYS = st.sampled_from(["a", "b", "answers", "score", "x y", "空"])
JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["", " ", "v", "【x】", '"q"', "[1]"]), lambda s: st.lists(s, max_size=3) | st.dictionaries(KEYS, s, max_size=3), max_leaves=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(JSON, max_size=3) | st.dictionaries(KEYS, JSON, max_size=3), min_size=1, max_size=20))
def test_against_recursion(spark, values):
    got = flat(spark, [json.dumps(v, ensure_ascii=False) for v in values])
    assert sorted((i, p) for i, p, _ in got) == sorted((str(i), p) for i, v in enumerate(values) for p in leaves(v))


def test_links_to_parents(spark):
    plan = spark.createDataFrame([("p", ["1", "1", None, "9"]), ("q", ["1"]), ("r", None)], "question_id string, child_question_ids array<string>")
    units = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", None)], "question_id string, answer string")
    assert sorted(map(tuple, N.answer_values(units, plan).select("parent_question_id", "question_id", "leaf_path").collect())) == [("2", "2", "$"), ("p", "1", "$"), ("q", "1", "$")]
