import hashlib

import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


@pytest.mark.parametrize("html,plain", [
    ("CO<sub>2</sub>", "CO_{2}"), ("a<sup>2</sup><sup>+</sup>", "a^{2+}"), ("x&nbsp;&lt;y&gt;", "x <y>"), ("<p>A</p><p>B</p>", "A B"), ("50%", "50\\%"), ("（ ）", "( )"),
    ("<img src='x'><br/>题", "题"), ('<span class="underline fillblank">a</span>', "______"), ("ＡＢ，１", "AB，1"), ("x ≥ 1", "x >= 1"), ("$a$ b", "a b"), (None, ""), ("", ""), ("甲 。", "甲。"), ("()", "(   )"),
])
def test_html(spark, html, plain):
    assert one(spark, html, X.html_normalize) == plain


@pytest.mark.parametrize("raw,text", [
    ('[{"index": 1, "answers": ["CO_{2}"]}, {"index": 0, "answers": ["甲", "乙"]}]', "空1：甲 / 乙；空2：CO_{2}"), ("true", "true"), ("[true, null, 2]", "是；2"), ('{"b": "x", "a": ["y"]}', "a：y；b：x"), ("C", "C"), (None, ""), ("[1", None), ('"[\\"A\\"]"', "A"),
])
def test_answer(spark, raw, text):
    assert one(spark, raw, lambda c: X.answer_text(F.col(c))) == text


def test_tokens(spark):
    assert one(spark, "DNA-1 光合作用 水 x", X.tokens) == ["dna-1", "x", "光合", "合作", "作用", "光合作", "合作用", "光合作用", "水"]
    assert one(spark, None, X.tokens) == []
    assert len(one(spark, "一" * 13, X.tokens)) == 12 + 11


def test_clip_and_paths(spark):
    assert one(spark, "abcdefghij", lambda c: X.head_tail(c, 6)) == "ab…[中间省略]…ghij"
    assert one(spark, "abc", lambda c: X.head_tail(c, 6)) == "abc"
    assert one(spark, "A->B->C", X.path_text) == "A@B@C"
    assert one(spark, "A→B", X.path_text) == "A→B"
    assert one(spark, "A->B->C", X.path_parent) == "A->B"
    assert one(spark, "A", X.path_parent) == ""
    assert [one(spark, v, X.path_module) for v in ("A->B->C", "A", None)] == ["B", "missing", "missing"]


def test_hash_rank(spark):
    assert one(spark, "k", lambda c: X.hash_rank("s", c)) == hashlib.sha256(b"s\0k").hexdigest()


@pytest.mark.parametrize("old,new,name", [(["1", "2"], ["1", "2"], "exact_match"), (["1", "2"], ["1", "2", "3"], "contains_all_legacy"), (["1", "2"], ["1"], "subset_of_legacy"), (["1", "2"], ["1", "3"], "mixed"), (["1", "2"], ["9"], "disjoint"), (["1"], [], "subset_of_legacy")])
def test_relationship(spark, old, new, name):
    df = spark.createDataFrame([(old, new)], "a array<string>, b array<string>")
    assert df.select(X.relationship("a", "b")).first()[0] == name


def test_jaccard_and_change(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"]), (["a"], []), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [tuple(r) for r in df.select(X.jaccard("a", "b"), X.change("a", "b")).collect()] == [(1.0, "both_empty"), (0.5, "more"), (0.0, "fewer"), (0.0, "replaced")]


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.39,), (0.40,), (0.70,), (0.80,)], "x double")
    assert [r[0] for r in df.select(X.score_band("x")).collect()] == ["zero", "weak_related", "gray", "borderline_match", "high_match"]
    n = spark.createDataFrame([(29,), (99,), (299,), (499,), (500,)], "x int")
    assert [r[0] for r in n.select(X.sample_tier("x")).collect()] == ["LT1", "LT2", "LT3", "ADEQUATE", "CAPPED"]
    k = spark.createDataFrame([(None,), (0,), (1,), (6,), (25,), (26,)], "x int")
    assert [r[0] for r in k.select(X.rank_band("x")).collect()] == ["unknown", "unknown", "1-5", "6-10", "11-25", "26+"]
    lp = spark.createDataFrame([(None, None), (0.0, -10.0)], "t double, f double")
    assert [round(r[0], 4) for r in lp.select(X.logistic_of("t", "f")).collect()] == [0.5, 1.0]


def test_conditions():
    assert X.parse_condition("warm:0.7:5:4:11") == {"name": "warm", "temperature": 0.7, "choices": 5, "workers": 4, "seed": 11}
    for bad in ("x", "a:1:0:2", "a:b:1:1"):
        with pytest.raises(ValueError):
            X.parse_condition(bad)


def test_alignment_and_columns(spark):
    df = spark.createDataFrame([(3, False, False), (5, True, False), (5, False, True), (5, False, False)], "s int, issue boolean, need boolean")
    assert [r[0] for r in df.select(X.alignment_class("s", "issue", "need")).collect()] == ["L3", "L3", "L2", "L1"]
    row = spark.sql("select 'abcdef' a, 1 legacy_x, named_struct('p', 1, 'q', 2) flags")
    assert tuple(row.select(*X.prefixes({"a": 3})).first()) == ("abc",)
    assert X.without_prefix(row, "legacy_", {"flags": ["q"]}).schema.simpleString() == "struct<a:string,flags:struct<p:int>>"


def test_unescape_as_the_standard_library(spark):
    import html

    cases = ["", "a&b", "&", "&&amp;", "&amp", "&ampx;", "&lt;p&gt;", "&nbsp;x", "&notit;", "&notin;", "&#65;&#x41;&#X1F600;", "&#0;", "&#128;&#x9f;&#13;", "&#xD800;", "&#1114112;", "&#99999999999999;", "&#xffffffffffff;", "&#xfdd0;", "&#65534;", "&#12288;", "&hearts;&Hearts;&zz;", "&#;&#x;", "x & y &copy 2 &copyright; &Aacute", "&#0000065;", "&#8;", "&NotEqualTilde;", "a;&b;c", "&unknownnamethatisverylongindeedyes;", "&#x2003;t"]
    df = spark.createDataFrame([(c,) for c in cases], "x string").select("x", X.unescape("x").alias("y"))
    assert [(r.x, r.y) for r in df.collect()] == [(c, html.unescape(c)) for c in cases]
