import pytest
from pyspark.sql import functions as F

from tagloom.plans import scoring as S


class Picky:
    """Fails on any batch that holds task 13, and on more than 4 tasks."""

    def score(self, tasks):
        if len(tasks) > 4 or any(t["task_id"] == "13" for t in tasks):
            raise S.Refused("too large" if len(tasks) > 4 else "bad task")
        return [{"score": 0.5, "selected": ["C01"]} for _ in tasks]


def tasks(spark, n=20):
    return spark.range(n).select(F.col("id").cast("string").alias("task_id"))


def test_batches_are_halved_and_failures_isolated(spark):
    r = {x.task_id: x for x in S.run(tasks(spark), Picky(), batch=16, in_flight=2).collect()}
    assert len(r) == 20 and [k for k, v in r.items() if v.error] == ["13"]
    assert r["13"].score is None and "bad task" in r["13"].error and r["1"].selected == ["C01"]


class Dead:
    """An endpoint that is down: the batch is not taken apart."""

    def score(self, tasks):
        if len(tasks) < 8:
            return [{"score": 0.1, "selected": []} for _ in tasks]
        raise ConnectionError("down")


def test_a_dead_endpoint_is_called_once_a_batch(spark):
    r = S.run(tasks(spark, 8).coalesce(1), Dead(), batch=8).collect()
    assert all("ConnectionError" in x.error and x.attempts == 1 for x in r) and len(r) == 8


def test_a_bad_request_is_halved():
    class Http(Exception):
        status = 400

    class One:
        def score(self, ts):
            if len(ts) > 1:
                raise Http("too long")
            return [{"score": 1.0, "selected": []}]

    assert [x["score"] for x in S._attempt(One(), [{}] * 4)] == [1.0] * 4


def test_rate_is_shared(monkeypatch):
    slept = []
    clock = iter([0.0, 0.0, 0.0])
    monkeypatch.setattr(S.time, "monotonic", lambda: next(clock))
    monkeypatch.setattr(S.time, "sleep", slept.append)
    S.ChatScorer(lambda e, p: "{}", ["a"], lambda t: t, rate=2.0, in_flight=4).score([{}, {}, {}])
    assert slept == [2.0, 4.0]


def test_empty(spark):
    assert S.run(tasks(spark, 0), Picky()).count() == 0


def test_stub_does_not_depend_on_layout(spark):
    a, b = (sorted((x.task_id, x.score) for x in S.run(tasks(spark).repartition(n), S.HashScorer()).collect()) for n in (1, 5))
    assert a == b


def test_chat_scorer_turns_and_retries():
    seen = []

    def send(endpoint, payload):
        seen.append(endpoint)
        if endpoint == "a":
            raise TimeoutError("slow")
        return 'Sure: ```json\n{"selected": ["C01"], "score": 1}\n```'

    out = S.ChatScorer(send, ["a", "b"], lambda t: t, tries=2, wait=0).score([{"task_id": "1"}])
    assert out == [{"selected": ["C01"], "score": 1, "attempts": 2}] and seen == ["a", "b"]
    assert "TimeoutError" in S.ChatScorer(send, ["a"], lambda t: t, tries=2, wait=0).score([{}])[0]["error"]


@pytest.mark.parametrize("reply", ["nothing", "[1]", "{broken"])
def test_json_object_refuses(reply):
    with pytest.raises(ValueError):
        S.json_object(reply)


def test_resume(spark):
    ev = spark.createDataFrame([("1", None), ("2", "x"), ("2", ""), ("3", "x")], "task_id string, error string")
    assert sorted(r.task_id for r in S.resume(tasks(spark, 5), ev).collect()) == ["0", "3", "4"]
    S.resume(tasks(spark), ev, {"m": 1, "output_safety": 2}, {"m": 1})
    with pytest.raises(ValueError):
        S.resume(tasks(spark), ev, {"m": 1}, {"m": 2})


def test_codes_round_trip(spark):
    c = spark.createDataFrame([("q", "1"), ("q", "2"), ("r", "1")], "question_id string, label_id string")
    codes = S.anonymous(c, "s")
    res = spark.createDataFrame([("q", [" c01 ", "C09"]), ("r", [])], "question_id string, selected array<string>")
    out = {r.question_id: r for r in S.decode(res, codes).collect()}
    assert len(out["q"].selected) == 1 and out["q"].need_expand and out["r"].selected == [] and not out["r"].need_expand


def test_manifest_and_verify(spark):
    S.same_manifest(spark.createDataFrame([("v1", "m"), ("v2", "m")], "vote string, model string"), ["model"])
    with pytest.raises(ValueError):
        S.same_manifest(spark.createDataFrame([("v1", "m"), ("v2", "n")], "vote string, model string"), ["model"])
    p = spark.createDataFrame([("q", "1"), ("q", "2"), ("r", "3")], "question_id string, label_id string")
    k = spark.createDataFrame([("q", "1", True), ("r", "3", False)], "question_id string, label_id string, match boolean")
    assert sorted(map(tuple, S.verify(p, k).collect())) == [("q", "1", True, False), ("q", "2", False, False), ("r", "3", False, True)]


def test_preflight():
    S.preflight(lambda e: ["m", "n"], ["a"], "m")
    with pytest.raises(ValueError):
        S.preflight(lambda e: ["m"] if e == "a" else [], ["a", "b"], "m")
