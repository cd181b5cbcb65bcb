import random

from tagloom.functions import text as X
from tagloom.operators import sampling as S


def by_hand(spark, rows, k):
    h = dict(spark.createDataFrame([(r[0],) for r in rows], "id string").select("id", X.hash_rank(S.SEED, "id")).collect())
    count, seen, out = {}, {}, []
    for _, tags in rows:
        for t in tags:
            count[t] = count.get(t, 0) + 1
    left = dict(rows)
    while left and len(out) < k:
        best = min(left, key=lambda i: (-sum(1 / count[t] / (1 + seen.get(t, 0)) for t in left[i]), h[i]))
        for t in left.pop(best):
            seen[t] = seen.get(t, 0) + 1
        out.append(best)
    return out


def test_greedy_sees_every_row_whatever_the_driver_holds(spark):
    rnd = random.Random(4)
    rows = [(f"q{i}", sorted(rnd.sample([f"t{int(rnd.paretovariate(0.7)) % 60}" for _ in range(4)], 3))) for i in range(300)]
    rows = [(i, sorted(set(t))) for i, t in rows] + [("none", [])]
    df = spark.createDataFrame(rows, "id string, tags array<string>")
    want = by_hand(spark, rows, 40)
    for bound in (1, 7, 20_000):
        assert S.greedy_rare(df, "id", "tags", 40, bound=bound) == want
    assert set(S.greedy_rare(df, "id", "tags", 1_000, bound=150)) == {i for i, _ in rows}
