from tagloom.operators import retrieval as R


def test_quotas_and_cap_of_the_original(spark, tmp_path):
    one = lambda p, m: ("q", m, [(f"{p}{k:02d}", 1 - k / 100) for k in range(30)])
    spark.createDataFrame([one("s", "bm25-char"), one("d", "dense")], "question_id string, method string, candidates array<struct<label_id:string,score:double>>").write.parquet(f"{tmp_path}/candidates.parquet")
    got = [(r.label_id, r.stage) for r in R.q_quota(spark, str(tmp_path)).orderBy("rk").collect()]
    assert got == [(f"s{k:02d}", 1) for k in range(18)] + [(f"d{k:02d}", 2) for k in range(7)]
    assert {(r.stage, r.mix): r.n for r in R.q_source_mix(spark, str(tmp_path)).collect()} == {(1, "sparse"): 18, (2, "dense"): 7}
