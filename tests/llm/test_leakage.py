import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import leakage as M


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abcd", max_size=12))
def test_edit_distance(a, b):
    assert M.edit_distance(a, b) == levenshtein(a, b)


def word(rnd, n):
    return "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n))


def stretch(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in M.leaks(d, "doc_id", i, "item_id").collect()}


def test_every_stretch_is_found(spark):
    rnd = random.Random(4)
    items = [(k, word(rnd, rnd.randrange(60, 300))) for k in range(25)]
    docs = []
    for k in range(150):
        i, t = rnd.choice(items)
        n = rnd.randrange(40, 70)
        at = rnd.randrange(0, max(1, len(t) - n))
        part = "。 ".join(t[at : at + n]) if k % 3 == 0 else t[at : at + n].upper()
        docs.append((k, word(rnd, rnd.randrange(0, 200)) + part + word(rnd, rnd.randrange(0, 200))))
    docs += [(0, docs[0][1]), (900, None), (901, ""), (902, "短"), (None, items[0][1])]
    low = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    want = {(d, i) for d, t in docs if d is not None for i, x in items if stretch(low(t), low(x)) >= 50}
    got = run(spark, docs, items)
    assert {k for k, r in got.items() if r.stretch >= 50} == want and len(want) > 60
    assert all(r.stretch == stretch(low(dict(docs)[d]), low(dict(items)[i])) for (d, i), r in got.items() if r.stretch >= 50)


def test_edited_passages(spark):
    """Passages with an edit about every 25 characters have hardly a window without one; most are found all the same."""
    rnd = random.Random(8)
    items, docs = [], []
    for k in range(60):
        t = word(rnd, 240)
        e = list(t)
        for p in range(12, 240, 25):
            e[p] = rnd.choice(["", "甲", e[p] + "乙"])
        items.append((k, t))
        docs.append((k, word(rnd, 100) + "".join(e) + word(rnd, 100)))
    got = run(spark, docs, items)
    assert sum((k, k) in got for k in range(60)) >= 54
    assert all(d == i for d, i in got) and all(r.edits <= M.EDITS for r in got.values())


def test_blocks_of_items(spark, monkeypatch):
    rnd = random.Random(6)
    items = [(k, word(rnd, 120)) for k in range(12)]
    docs = [(k, t) for k, t in items]
    whole = {k: tuple(r) for k, r in run(spark, docs, items).items()}
    monkeypatch.setattr(M, "BLOCK_CHARS", 300)
    assert {k: tuple(r) for k, r in run(spark, docs, items).items()} == whole and len(whole) == 12


def test_empty_and_long(spark):
    rnd = random.Random(7)
    t = word(rnd, 100)
    assert run(spark, [], [(1, t)]) == {} and run(spark, [(1, t)], []) == {}
    long = word(rnd, 300_000)
    assert run(spark, [(1, long + t)], [(5, t), (6, "短"), (7, None)])[1, 5].stretch >= 100


def test_recall_of_edited_passages_end_to_end():
    """What the docstring promises: passages of SURE characters with up to EDITS edits, and of 50 with one, wherever the edits are."""
    rnd = random.Random(12)
    word = lambda n: "".join(chr(0x4E00 + rnd.randrange(2000)) for _ in range(n))
    items = [word(rnd.randrange(120, 400)) for _ in range(200)]
    index = M.Index(list(range(len(items))), items)

    def edited(t, n):
        t = list(t)
        for k in sorted(rnd.sample(range(len(t)), n), reverse=True):
            t[k : k + rnd.choice([0, 1, 1])] = rnd.choice(["", word(1), word(1)])
        return "".join(t)

    for size, edits in [(M.SURE, e) for e in range(M.EDITS + 1)] + [(50, 0), (50, 1), (120, M.EDITS)]:
        texts = []
        for i in range(200):
            at = rnd.randrange(len(items[i]) - size + 1)
            texts.append(word(90) + edited(items[i][at : at + size], edits) + word(90))
        found = {(d, i) for d, i, *_ in index.search(texts)}
        recall = sum((k, k) in found for k in range(200)) / 200
        assert recall >= (0.9 if edits else 1.0), (size, edits, recall)


def test_a_window_of_all_items_is_indexed_once():
    head = "".join(chr(0x4E00 + k) for k in range(60))
    items = [head + "".join(chr(0x5E00 + 40 * i + k) for k in range(40)) for i in range(50)]
    index = M.Index(list(range(50)), items)
    assert len(index.first) - 1 <= index.windows.sum() - 49
    got = index.search(["前" * 40 + items[7] + "后" * 40])
    assert {i for _, i, *_ in got} == set(range(50)) and {s for _, i, s, *_ in got if i == 7} == {100} and {s for _, i, s, *_ in got if i != 7} == {60}
