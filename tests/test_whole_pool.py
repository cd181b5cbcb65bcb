from tagloom.operators import review as R
from tagloom.plans import scoring as S


def pairs(spark, path):
    """q: 8 of each list and 35 of a third method; r: as q, but other labels from the sixth on."""
    c = lambda ids: [(i, 1 - k / 100) for k, i in enumerate(ids)]
    own = [f"s{k}" for k in range(8)], [f"d{k}" for k in range(8)], [f"h{k:02d}" for k in range(35)]
    rows = [("q", m, c(x)) for m, x in zip(("bm25-char", "dense", "hybrid"), own)]
    rows += [("r", m, c(x[:5] + [f"{i}x" for i in x[5:]])) for m, x in zip(("bm25-char", "dense", "hybrid"), own)]
    spark.createDataFrame(rows, "question_id string, method string, candidates array<struct<label_id:string,score:double>>").write.parquet(f"{path}/candidates.parquet")
    return str(path)


def test_all_candidates_are_scored_coded_and_signed(spark, tmp_path):
    d = pairs(spark, tmp_path)
    assert S.q_stub(spark, d).count() == S.q_codes(spark, d).count() == 102
    assert S.q_threshold(spark, d).agg({"n": "sum"}).first()[0] == 102
    assert len({x.signature for x in R.q_signature(spark, d).collect()}) == 2


def test_rerank_takes_the_union_of_thirty(spark, tmp_path):
    r = S.q_rerank(spark, pairs(spark, tmp_path)).where("question_id = 'q'").collect()
    assert {x.label_id for x in r} == {f"{m}{k}" for m in "sd" for k in range(8)} and {x.rk for x in r} == set(range(1, 17))


def test_coarse_recall_offers_every_candidate(spark, tmp_path):
    got = {x.question_id: x.selected.split("|") for x in R.q_coarse(spark, pairs(spark, tmp_path)).collect()}
    score = lambda q, i: S.HashScorer("coarse").score([{"task_id": f"{q}::{i}"}])[0]["score"]
    own = [f"{m}{k}" for m in "sd" for k in range(8)] + [f"h{k:02d}" for k in range(35)]
    assert got["q"] == sorted(i for i in own if score("q", i) >= 0.5)
