import random

import duckdb
import numpy as np

from tagloom.llm import consensus as M
from tests.conftest import plain

SCHEMA = "seq long, vote string, question_id string, error string, choices array<struct<index:int,finish_reason:string,selected_label_ids:array<string>,parse_error:string>>, label_id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def ch(*sets, bad=None):
    return [(i, "stop", s, bad) for i, s in enumerate(sets)]


def test_ballots(spark):
    rows = [
        (1, "a", "q", None, ch(["x"])), (2, "a", "q", "", ch(["y", "y", None], ["y"], ["z"])), (3, "a", "q", "boom", ch(["w"])), (4, "a", "q", None, ch(["w"], bad="broken")), (5, "a", "q", None, []), (6, "a", "q", None, None),
        (7, "b", "q", None, ch([], None, ["x"])), (8, "b", "q", None, [None]), (9, None, "q", None, ch(["x"])), (10, "c", None, None, ch(["x"])), (2, "a", "q", "", ch(["y", "y", None], ["y"], ["z"])),
    ]
    assert sorted((r.vote, r.labels) for r in M.ballots(table(spark, rows)).collect()) == [("a", ["y"]), ("b", [])]


def test_majority_needs_three(spark):
    rows = [(k, v, "q", None, ch(["x"])) for k, v in enumerate("ab")] + [(k, v, "p", None, ch(["x"] if v != "c" else [])) for k, v in enumerate("abc", 10)]
    labels, _ = M.consensus(table(spark, rows))
    assert {(r.question_id, r.majority) for r in labels.collect()} == {("q", False), ("p", True)}


def test_empty(spark):
    labels, judges = M.consensus(table(spark, []))
    assert labels.count() == 0 and judges.count() == 0


def planted(skill, labels, questions, share, rnd):
    rows, truth = [], {}
    for q in range(questions):
        for x in labels:
            truth[str(q), x] = rnd.random() < share
        for v, (tpr, fpr) in skill.items():
            picked = [x for x in labels if rnd.random() < (tpr if truth[str(q), x] else fpr)]
            rows.append((len(rows), v, str(q), None, ch(picked)))
    return rows, truth


def test_reliability_is_recovered(spark):
    """Simulated annotators: the estimated rates are close to the true ones, and weighting beats the plain majority, which three poor annotators win against two good ones."""
    rnd = random.Random(3)
    skill = {"a": (0.95, 0.05), "b": (0.9, 0.1), "c": (0.6, 0.4), "d": (0.55, 0.45), "e": (0.58, 0.42)}
    rows, truth = planted(skill, "xyz", 700, 0.45, rnd)
    labels, judges = M.consensus(table(spark, rows))
    j = {r.vote: r for r in judges.collect()}
    assert all(abs(j[v].informedness - (t - f)) < 0.15 for v, (t, f) in skill.items()), {v: r.informedness for v, r in j.items()}
    assert j["a"].w_yes > j["b"].w_yes > j["c"].w_yes and abs(j["a"].prior - 0.45) < 0.1
    got = labels.collect()
    right = lambda f: np.mean([f(r) == truth[r.question_id, r.label_id] for r in got])
    assert right(lambda r: r.likely) > right(lambda r: r.yes * 2 > r.annotators) + 0.02
    assert sum(1 for r in got if r.likely == truth[r.question_id, r.label_id] != r.majority) > 100


def test_prior_of_rare_labels(spark):
    """Items that nobody selected are counted, not seen: with 1 true label in 25 the prior comes from the moments, far from a majority's share of the selected ones."""
    skill = {"a": (0.9, 0.01), "b": (0.85, 0.02), "c": (0.8, 0.01), "d": (0.7, 0.03)}
    rows, truth = planted(skill, [f"l{k}" for k in range(25)], 400, 0.04, random.Random(5))
    _, judges = M.consensus(table(spark, rows))
    j = {r.vote: r for r in judges.collect()}
    assert abs(j["a"].prior - 0.04) < 0.012
    assert all(abs(j[v].tpr - t) < 0.1 and abs(j[v].fpr - f) < 0.01 for v, (t, f) in skill.items())


def test_reach_bounds_the_triplets(spark):
    skill = {f"v{k}": (0.8, 0.2) for k in range(7)}
    rows, _ = planted(skill, "xy", 60, 0.5, random.Random(6))
    cast = M.ballots(table(spark, rows))
    three = [(r.i, r.j, r.k) for r in M.triplets(cast, M.ranks(cast), 2, reach=3).collect()]
    assert len(three) == len(set(three)) == 4 * 3 + 1 + 0
    every = sorted(map(tuple, M.triplets(cast, M.ranks(cast), 2).collect()))
    assert len(every) == 35 and len({frozenset(r[:3]) for r in every}) == 35


def test_both_ways_to_meet_give_the_same_moments(spark):
    """A question's ballots in one row, or joined with their partners: the same sums, whichever annotator comes first."""
    rows, _ = planted({f"v{k}": (0.8, 0.2) for k in range(5)}, "xyz", 40, 0.5, random.Random(7))
    cast = M.ballots(table(spark, rows))
    key = lambda r: (frozenset((r.i, r.j, r.k)), r.questions, tuple(sorted(round(x, 9) for x in (r.cij, r.cik, r.cjk))), round(r.t, 9))
    one = {key(r) for r in M.triplets(cast, M.ranks(cast), 3, reach=4).collect()}
    order = M.ranks(cast).unionByName(spark.createDataFrame([("nobody", 0, 6)], "vote string, n long, r int"))
    assert {key(r) for r in M.triplets(cast, order, 3, reach=4).collect()} == one and len(one) == 10


def crowd(rnd, annotators=40, questions=12, labels=6):
    skill = {f"v{k}": (0.6 + k % 4 / 10, 0.05 + k % 3 / 10) for k in range(annotators)}
    rows, _ = planted(skill, [f"l{k}" for k in range(labels)], questions, 0.3, rnd)
    return [r for r in rows if rnd.random() < 0.9]


def by_sql(rows, name):
    """The query's own SQL on these rows."""
    c = duckdb.connect()
    c.sql("create table vote_responses (seq bigint, vote varchar, question_id varchar, error varchar, choices struct(selected_label_ids varchar[], parse_error varchar)[])")
    c.executemany("insert into vote_responses values (?, ?, ?, ?, ?)", [(s, v, q, e, [{"selected_label_ids": x[2], "parse_error": x[3]} for x in chosen]) for s, v, q, e, chosen in rows])
    return c.sql(M.ORACLES[name])


def test_more_annotators_than_a_row_holds(spark, tmp_path):
    """40 annotators a question: every triplet counts, in p6_annotators and in p6_labels, as in SQL."""
    rows = crowd(random.Random(8))
    table(spark, rows).write.parquet(str(tmp_path / "vote_responses.parquet"))
    for name in ("p6_annotators", "p6_labels"):
        want = by_sql(rows, name)
        assert plain(M.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()) == plain(want.fetchall())


def test_blocks_and_masks_miss_no_triplet(spark):
    """Each three ballots once, with one block or many, and more labels in a question than a mask has bits."""
    rows = crowd(random.Random(9), annotators=9, questions=8, labels=150)
    cast = M.ballots(table(spark, rows))
    key = lambda r: (r.i, r.j, r.k, r.questions, *(round(x, 12) for x in (r.cij, r.cik, r.cjk, r.t)))
    one, two, nine = ({key(r) for r in M.triplets(cast, None, 150, block=b).collect()} for b in (32, 5, 1))
    assert one == two == nine and len(one) == 84
    s = {(r.question_id, r.vote): set(r.labels) for r in cast.collect()}
    for i, j, k, questions, cij, *_ in one:
        met = [q for q in {q for q, _ in s} if all((q, v) in s for v in (i, j, k))]
        x, y, xy = (sum(map(len, v)) / (len(met) * 150) for v in ([s[q, i] for q in met], [s[q, j] for q in met], [s[q, i] & s[q, j] for q in met]))
        assert questions == len(met) and abs(cij - (xy - x * y)) < 1e-9


def test_medians_by_bins(spark):
    """Odd and even numbers of values, ties, values in one bin and beyond the last one."""
    rnd = random.Random(10)
    values = {"a": [rnd.random() for _ in range(501)], "b": [rnd.random() * 3 for _ in range(500)], "c": [0.25] * 7, "d": [0.0, 1.0], "e": [1e-9 * k for k in range(10)], "f": [300.0 + k for k in range(6)], "g": [5.0], "h": [0.0, 0.0, 9.0, 9.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "vote string, v double")
    got = {r.vote: (r.median, r.n) for r in M.medians(df, ["vote"], False).collect()}
    assert all(abs(got[k][0] - np.median(v)) < 1e-15 + 1e-12 * np.median(v) and got[k][1] == len(v) for k, v in values.items()) and len(got) == len(values)
    (r,) = M.medians(df, [], False).collect()
    assert abs(r.median - np.median(sum(values.values(), []))) < 1e-12 and M.medians(df.where("false"), [], False).first().median is None


def test_many_triplets_have_the_same_medians(spark, monkeypatch):
    cast = M.ballots(table(spark, crowd(random.Random(11), annotators=8)))
    want = plain(M.reliability(cast).collect())
    monkeypatch.setattr(M, "MAX_VALUES", 0)
    assert plain(M.reliability(cast).collect()) == want
