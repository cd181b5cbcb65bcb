import itertools
import os
import random

import pytest

from tagloom.llm import packing as M

HAVE = os.path.exists(f"{M.TOKENIZERS}/{M.VOCABULARY}")


def test_fullest_against_all_combinations():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = sorted({rnd.randrange(1, 40) for _ in range(6)}, reverse=True)
        counts = [(s, rnd.randrange(1, 3)) for s in sizes]
        pool = [s for s, n in counts for _ in range(n)]
        room = rnd.randrange(1, 90)
        best = max(sum(c) for k in range(len(pool) + 1) for c in itertools.combinations(pool, k) if sum(c) <= room)
        got = M.fullest(counts, room)
        assert sum(got) == best and all(got.count(s) <= n for s, n in counts)


def packed(spark, sizes, capacity=100, shard=500):
    df = spark.createDataFrame([(i, n) for i, n in sizes], "id long, n long")
    return M.packed(df, len(sizes), capacity, shard).collect()


def test_everything_is_placed_once_and_fits(spark):
    rnd = random.Random(2)
    sizes = [(i % 900, rnd.choice([0, 1, 5, 37, 60, 99, 100, 101, 250, 1000, rnd.randrange(1, 100)])) for i in range(1500)] + [(None, 40)]
    rows = packed(spark, sizes)
    assert sum(r.n_tokens for r in rows) == sum(n for _, n in sizes)
    assert len(rows) == sum(max(1, -(-n // 100)) for _, n in sizes)
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append((r.offset, r.n_tokens))
    for b in bins.values():
        at = 0
        for off, n in sorted(x for x in b if x[1]):
            assert off == at
            at += n
        assert at <= 100
    assert all(r.piece == 0 and r.start == 0 for r in rows if dict(sizes).get(r.id, 0) <= 100 and r.id is None)
    least = -(-sum(n for _, n in sizes) // 100)
    assert len(bins) <= least * 1.02 + 4


def test_only_long_documents_are_cut(spark):
    rows = packed(spark, [(1, 100), (2, 230), (3, 0)])
    assert sorted((r.id, r.piece, r.start, r.n_tokens) for r in rows) == [(1, 0, 0, 100), (2, 0, 0, 100), (2, 1, 100, 100), (2, 2, 200, 30), (3, 0, 0, 0)]


def test_empty(spark):
    assert packed(spark, []) == []


@pytest.mark.skipif(not HAVE, reason="no vocabulary files")
def test_documents(spark):
    df = spark.createDataFrame([(1, "光合作用 photosynthesis", 9), (2, None, 9), (3, "", 9), (1, "<|endoftext|>", 9), (4, "长" * 50_000, 9)], "doc_id long, text string, bin int")
    n = {r.id: 0 for r in M.pack_documents(df, "doc_id", "text").collect()}
    assert set(n) == {1, 2, 3, 4}
    enc = M.load_tokenizer(f"{M.TOKENIZERS}/{M.VOCABULARY}")
    got = sorted((r.id, r.n) for r in M.token_counts(df, "doc_id", "text").collect())
    assert got == sorted([(1, len(enc.encode_ordinary("光合作用 photosynthesis"))), (2, 0), (3, 0), (1, len(enc.encode_ordinary("<|endoftext|>"))), (4, len(enc.encode_ordinary("长" * 50_000)))])
