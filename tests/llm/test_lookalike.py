import pytest

from tagloom.llm import lookalike as M

S = M.skeleton_function()


@pytest.mark.parametrize("a,b", [("ＡＢ１", "AB1"), ("é", "é"), ("a​b⁠", "ab"), ("a b　c", "a b c"), ("Аbс", "Abc"), ("ΑΒο", "ABo"), ("加⼊", "加入"), ("更", "更"), ("x­y️", "xy"), ("①", "1"), ("ﬁ", "fi")])
def test_same(a, b):
    assert S(a) == S(b)


@pytest.mark.parametrize("a,b", [("a", "A"), ("a,", "a"), ("a  b", "a b"), ("a\nb", "a b"), ("é", "e"), ("β", "B"), ("。", "."), ("l", "1"), ("O", "0")])
def test_different(a, b):
    assert S(a) != S(b)


def test_letters_follow_the_unicode_prototypes(spark):
    """The table is the prototypes' own, less the letters left out; one letter without a prototype is added, and the small palochka is an l, not an i."""
    prototype = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    latin = {}
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        latin.setdefault(prototype(c), []).append(c)
    want = {}
    for c in (chr(k) for k in range(0x370, 0x530)):
        if c.isalpha() and (like := latin.get(prototype(c))):
            want[c] = ([x for x in like if x.isupper() == c.isupper()] or like)[0]
    own = {chr(k): chr(v) for k, v in M.PROTOTYPE.items()}
    assert set(want) - set(own) == set(M.LEFT_OUT) and set(own) - set(want) == {"Ԛ"}
    assert {c for c in own if c in want and want[c] != own[c]} == {"ӏ"}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "exchange_id long, stem string, options string, answer_text string, skel string")
    return sorted(map(tuple, M.lookalike_pairs(df, "exchange_id", M.FIELDS).collect()))


def test_pairs(spark):
    rows = [(3, "AB", None, "x"), (1, "ＡＢ", "", "x"), (2, "AB", "", "x"), (4, "AB", "", "y"), (5, "ab", "", "x"), (6, None, None, None), (7, "", "​", ""), (8, "", "", ""), (1, "ＡＢ", "", "x"), (9, "A", "B", "x")]
    assert run(spark, rows) == [(1, 2), (1, 3), (6, 7), (7, 8)]


def test_hot_class(spark):
    rows = [(i, "same", None, None) for i in range(400)] + [(1000, "ѕame", None, None)]
    assert run(spark, rows) == [(i, 1000) for i in range(400)]


def test_hot_class_on_either_side(spark):
    """Large groups on both sides of a pair, ids mixed."""
    rows = [(2 * i, "same", None, None) for i in range(120)] + [(2 * i + 1, "ѕame", None, None) for i in range(120)] + [(9999, "sаme", None, None)]
    got = run(spark, rows)
    assert len(got) == len(set(got)) == 120 * 120 + 240 and all(a < b for a, b in got)


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "exchange_id long, stem string, options string, answer_text string, skel string")
    return sorted(map(tuple, M.lookalike_groups(df, "exchange_id", M.FIELDS).collect()))


def test_groups(spark):
    rows = [(3, "AB", None, None), (1, "ＡＢ", "", ""), (2, "AB", "", ""), (4, "ab", "", ""), (2, "AB", None, None), (5, None, None, None)]
    assert groups(spark, rows) == [(1, 1, 1, 2, 3), (2, 1, 2, 2, 3), (3, 1, 2, 2, 3), (4, 4, 4, 1, 1), (5, 5, 5, 1, 1)]
    assert groups(spark, []) == []


def test_empty_and_long(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "字" * 200_000, "", ""), (2, "字" * 200_000 + "​", "", "")]) == [(1, 2)]


def test_one_form(spark):
    df = spark.createDataFrame([(1, "ＡÉ", None)], "id long, stem string, other string")
    assert tuple(M.one_form(df, ["stem"]).first()) == (1, "AÉ", None)
