import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import neardup as N
from tagloom.llm.canon import alnum


def grams(t):
    return {t[i : i + 4] for i in range(len(t) - 3)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x | y))


def run(spark, rows, least=0.7, chars=20):
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "q string, t string, c int, tok string")
    docs = N.prepared(df, "q", alnum("t"), chars)
    return {(r.id_a, r.id_b): r.similarity for r in N.id_pairs(docs, N.class_pairs(docs, least)).collect()}


def edited(rnd, t, n):
    t = list(t)
    for _ in range(n):
        k = rnd.randrange(len(t))
        t[k : k + rnd.choice([0, 1, 1])] = rnd.choice(["", "甲", "乙", "丙"])
    return "".join(t)


def test_recall_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(n))
    rows = []
    for f in range(60):
        base = word(rnd.randrange(120, 400))
        rows += [(f"{f:03d}-{k}", edited(rnd, base, rnd.randrange(0, 14))) for k in range(4)]
    rows += [("dup-1", rows[0][1]), ("dup-2", rows[0][1]), ("dup-2", rows[0][1]), ("short", "甲乙"), ("none", None), ("empty", "")]
    ids = {i: t for i, t in rows if t and len(t) >= 20}
    names = sorted(ids)
    want = {(a, b): s for k, a in enumerate(names) for b in names[k + 1 :] if (s := similarity(ids[a], ids[b])) >= 0.7}
    got = run(spark, rows)
    assert set(got) <= set(want) and len(want) > 150
    assert len(got) >= 0.98 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_copies_are_pairs(spark):
    rows = [(f"{i:02d}", "同一个文本" * 30) for i in range(30)]
    got = run(spark, rows)
    assert len(got) == 30 * 29 // 2 and set(got.values()) == {1.0}


def test_one_id_with_two_texts_and_empty(spark):
    a = "".join(chr(0x4E00 + i) for i in range(200))
    assert run(spark, [("1", a), ("1", a[1:])]) == {}
    assert run(spark, []) == {}


def test_long_text(spark):
    rnd = random.Random(2)
    a = "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(60_000))
    assert list(run(spark, [("1", a), ("2", a[:-5] + "甲乙丙")])) == [("1", "2")]


def test_prefix_and_skip_agree_with_full_count(spark):
    """Whatever is skipped, and in whatever order frequent values come, the pairs are those of counting all coordinates."""
    rnd = random.Random(9)
    base = [chr(0x4E00 + rnd.randrange(900)) for _ in range(150)]
    rows = [(str(k), edited(rnd, "".join(base), 1 + k % 40)) for k in range(60)]
    docs = N.prepared(spark.createDataFrame(rows, "q string, t string"), "q", F.col("t"), 20)
    sigs = N.class_signatures(docs)
    sig = {r.c: np.frombuffer(r.sig, np.uint32) for r in sigs.collect()}
    tops = N.frequent(sigs)
    assert len(tops[0]) > 10
    for match, seen in ((4, 2), (12, 4), (16, 1)):
        want = {(a, b) for a in sig for b in sig if a < b and (sig[a] == sig[b]).sum() >= match}
        got = [(r.ca, r.cb) for r in N.candidates(sigs, match=match, seen=seen).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_long_lists_are_joined_in_parts(spark, monkeypatch):
    """One large family of different versions: its lists are split, and no pair is lost."""
    monkeypatch.setattr(N, "LIST", 8)
    rnd = random.Random(3)
    base = "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(300))
    rows = [(f"{k:03d}", edited(rnd, base, 3)) for k in range(90)]
    rows += [(f"x{k:03d}", "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(200))) for k in range(60)]
    names = sorted(r[0] for r in rows)
    text = dict(rows)
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if similarity(text[a], text[b]) >= 0.7}
    assert set(run(spark, rows)) == want and len(want) > 3_000


def test_a_third_of_all_rows_in_one_class(spark):
    """The class stands on either side of its pairs, whichever hash is smaller; every copy is paired with every version."""
    rnd = random.Random(4)
    base = "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(200))
    versions = [edited(rnd, base, 2) for _ in range(6)]
    rows = [(f"c{k:03d}", base) for k in range(40)] + [(f"v{k}", v) for k, v in enumerate(versions)]
    got = set(run(spark, rows))
    assert {(f"c{k:03d}", f"v{j}") for k in range(40) for j in range(6)} <= got and len(got) == 46 * 45 // 2
    df = spark.createDataFrame(rows, "q string, t string")
    docs = N.prepared(df, "q", F.col("t"), 20)
    out = {r.id: (r.class_id, r.group_id, r.n_links) for r in N.groups(docs, N.class_pairs(docs, 0.7)).collect()}
    assert len(out) == 46 and all(out[f"c{k:03d}"] == ("c000", "c000", 6) for k in range(40)) and {v[1] for v in out.values()} == {"c000"}


def test_groups_of_chains(spark):
    """A chain whose ends are not similar is one group; a text alone is its own."""
    rnd = random.Random(6)
    t = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(400))
    rows = [(f"{k:02d}", t[k * 20 : k * 20 + 200]) for k in range(10)] + [("alone", t[::-1]), ("alone", t[::-1])]
    docs = N.prepared(spark.createDataFrame(rows, "q string, t string"), "q", F.col("t"), 20)
    out = {r.id: (r.class_id, r.group_id, r.n_links) for r in N.groups(docs, N.class_pairs(docs, 0.7)).collect()}
    assert out.pop("alone") == ("alone", "alone", 0)
    assert all(v[:2] == (k, "00") for k, v in out.items()) and out["00"][2] == 1 and out["05"][2] == 2
    none = N.prepared(spark.createDataFrame([], "q string, t string"), "q", F.col("t"), 20)
    assert N.groups(none, N.class_pairs(none, 0.7)).collect() == []


def test_components_against_union_find(spark):
    rnd = random.Random(8)
    edges = [(f"n{rnd.randrange(400):03d}", f"n{rnd.randrange(400):03d}") for _ in range(250)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(20)] + [("hub", f"h{k}") for k in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_exact_grams():
    a, b = "甲乙丙丁戊己", "乙丙丁戊庚辛"
    assert N.jaccard(*N.gram_sets([a, b], 4)) == similarity(a, b) == 1 / 5
    assert N.jaccard(*N.gram_sets(["abc", a], 4)) == 0.0
