"""External scorers behind one interface: batches of tasks in, scores or label sets out, with resume, retries and adaptive splits.

A scorer is any object with score(list[dict]) -> list[dict]; it is pickled to the tasks. The number of partitions bounds how many batches are in
flight. A batch that is refused for what it holds (Refused, ValueError or an error with status 400) is halved until single tasks are refused; any
other failure, such as a dead endpoint, would meet the halves too and is kept in all rows of the batch. A failed task never fails the job."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.plans import base
from tagloom.runtime import assert_empty, table

OUT = "selected array<string>, score double, error string, attempts int"
UNION = 30  # ranks of the sparse and of the dense list that are reranked, and pairs a question that stay, as in the original


class Scorer(Protocol):
    def score(self, tasks: list[dict]) -> list[dict]: ...


class Refused(ValueError):
    """The scorer can't take this batch or its reply doesn't fit it; parts of it may do."""


class HashScorer:
    """An offline stand-in for a model: the score is the first 32 bits of the task's hash; selected are the ids that reach a share of it."""

    def __init__(self, seed: str = "stub"):
        self.seed = seed

    def score(self, tasks: list[dict]) -> list[dict]:
        return [{"score": int(hashlib.sha256(f"{self.seed}:{t['task_id']}".encode()).hexdigest()[:8], 16) / 2**32, "selected": []} for t in tasks]


class ChatScorer:
    """A model behind `send(endpoint, payload) -> text`, which the caller provides. A task stays with one endpoint, its partition's, so that an
    endpoint has ceil(in_flight / endpoints) requests in flight at most; a failure waits longer each time, with jitter, and goes to the next
    endpoint. rate bounds the requests a second of all tasks together: each of the in_flight tasks keeps its share of it. The reply must hold one JSON object."""

    def __init__(self, send: Callable[[str, dict], str], endpoints: list[str], render: Callable[[dict], dict], tries: int = 3, wait: float = 1.0, rate: float | None = None, in_flight: int = 1):
        self.send, self.endpoints, self.render, self.tries, self.wait = send, endpoints, render, tries, wait
        self.gap = in_flight / rate if rate else 0.0
        self.turn, self.due = None, 0.0

    def paced(self) -> None:
        now = time.monotonic()
        if self.gap and now < self.due:
            time.sleep(self.due - now)
        self.due = max(now, self.due) + self.gap

    def one(self, task: dict) -> dict:
        if self.turn is None:
            self.turn = context.partitionId() if (context := TaskContext.get()) else 0
        problem = None
        for n in range(self.tries):
            self.paced()
            endpoint = self.endpoints[self.turn % len(self.endpoints)]
            try:
                return {**json_object(self.send(endpoint, self.render(task))), "attempts": n + 1}
            except Exception as e:  # noqa: BLE001
                problem = e
                self.turn += 1
                if n + 1 < self.tries:
                    time.sleep(self.wait * 2**n * random.uniform(0.8, 1.2))
        return {"error": f"{type(problem).__name__}: {problem}", "attempts": self.tries}

    def score(self, tasks: list[dict]) -> list[dict]:
        return [self.one(t) for t in tasks]


def preflight(models: Callable[[str], list[str]], endpoints: list[str], model: str) -> None:
    """Every endpoint must serve the model before a run begins."""
    if missing := [e for e in endpoints if model not in models(e)]:
        raise ValueError(f"{model} is not served by {missing}")


def json_object(reply: str) -> dict:
    """The JSON object of a reply, also inside a fenced block or between words."""
    body = m.group(1) if (m := re.search(r"```(?:json)?\s*(.*?)```", reply, re.S)) else reply
    start = body.find("{")
    if start < 0:
        raise ValueError("no JSON object in the reply")
    value, _ = json.JSONDecoder().raw_decode(body, start)
    if not isinstance(value, dict):
        raise ValueError("the reply is no JSON object")
    return value


def _splits(e: Exception) -> bool:
    return isinstance(e, ValueError) or getattr(e, "status", None) == 400


def _attempt(scorer: Scorer, tasks: list[dict], depth: int = 0) -> list[dict]:
    try:
        out = scorer.score(tasks)
        if len(out) != len(tasks):
            raise Refused(f"{len(out)} results for {len(tasks)} tasks")
        return [{"attempts": depth + 1, **o} for o in out]
    except Exception as e:  # noqa: BLE001
        if len(tasks) == 1 or not _splits(e):
            return [{"error": f"{type(e).__name__}: {e}", "attempts": depth + 1} for _ in tasks]
        half = len(tasks) // 2
        return _attempt(scorer, tasks[:half], depth + 1) + _attempt(scorer, tasks[half:], depth + 1)


def run(tasks: DataFrame, scorer: Scorer, batch: int = 32, in_flight: int | None = None) -> DataFrame:
    """tasks with selected, score, error and attempts. tasks needs task_id; in_flight bounds the number of concurrent batches."""
    names = tasks.columns

    def go(frames):
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                out = _attempt(scorer, part.to_dict("records"))
                yield part.assign(selected=[o.get("selected") for o in out], score=pd.Series([o.get("score") for o in out], part.index, "float64"), error=[o.get("error") for o in out], attempts=pd.Series([o["attempts"] for o in out], part.index, "int32"))[[*names, "selected", "score", "error", "attempts"]]

    source = tasks.repartition(in_flight) if in_flight else tasks
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields)
    return source.mapInPandas(go, f"{schema}, {OUT}")


def resume(tasks: DataFrame, evidence: DataFrame, manifest: dict | None = None, previous: dict | None = None) -> DataFrame:
    """Tasks without a success in the evidence; a manifest that differs from the previous run's is an error (its `output_safety` may)."""
    if previous is not None:
        same = lambda m: {k: v for k, v in (m or {}).items() if k != "output_safety"}
        if same(manifest) != same(previous):
            raise ValueError("the manifest differs from that of the run to be resumed")
    done = evidence.where("coalesce(error, '') = ''").select("task_id").distinct()
    return tasks.join(done, "task_id", "left_anti")


def under_conditions(tasks: DataFrame, specs: list[str]) -> DataFrame:
    """Every task once for each condition `name:temperature:choices:workers[:seed]`."""
    c = [X.parse_condition(s) for s in specs]
    each = F.explode(F.array(*[F.struct(F.lit(x["name"]).alias("condition"), F.lit(x["temperature"]).alias("temperature"), F.lit(x["choices"]).alias("choices"), F.lit(x["seed"]).cast("int").alias("seed")) for x in c]))
    return tasks.withColumn("_c", each).select(*tasks.columns, "_c.*").withColumn("task_id", F.concat("task_id", F.lit("@"), "condition"))


def anonymous(ranked: DataFrame, seed: str) -> DataFrame:
    """Candidates of each question in an order by hash with codes C01..., so that a model sees no ranks. (question_id, label_id, code)"""
    w = Window.partitionBy("question_id").orderBy(X.hash_rank(seed, "question_id", "label_id", sep=":"), "label_id")
    return ranked.select("question_id", "label_id", F.format_string("C%02d", F.row_number().over(w)).alias("code"))


def decode(results: DataFrame, codes: DataFrame) -> DataFrame:
    """(question_id, selected, unknown): selected codes as label ids; codes that weren't offered are dropped and ask for a wider search."""
    e = results.select("question_id", F.explode_outer("selected").alias("code")).withColumn("code", F.upper(F.trim("code")))
    j = e.join(codes, ["question_id", "code"], "left")
    return j.groupBy("question_id").agg(F.array_sort(F.collect_set("label_id")).alias("selected"), F.count_if(F.col("code").isNotNull() & F.col("label_id").isNull()).alias("unknown")).withColumn("need_expand", F.col("unknown") > 0)


def rerank(pool: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """(question_id, label_id, score, rk): the pool's first k pairs of each question by score, then id."""
    tasks = pool.select("question_id", "label_id").distinct().withColumn("task_id", F.concat("question_id", F.lit("::"), "label_id"))
    s = run(tasks, scorer).where("error is null").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "label_id")
    return s.withColumn("rk", F.row_number().over(w).cast("bigint")).where(F.col("rk") <= k).select("question_id", "label_id", "score", "rk")


def verify(predicted: DataFrame, checks: DataFrame) -> DataFrame:
    """(question_id, label_id, kept, all_rejected): predicted labels kept where their check matched. checks: (question_id, label_id, match)."""
    j = predicted.join(checks, ["question_id", "label_id"], "left").withColumn("kept", F.coalesce("match", F.lit(False)))
    return j.withColumn("all_rejected", ~F.max("kept").over(Window.partitionBy("question_id"))).select("question_id", "label_id", "kept", "all_rejected")


def same_manifest(manifests: DataFrame, fields: list[str]) -> None:
    """Every run must share the fields of the controller's manifest."""
    assert_empty(manifests.agg(*[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields]).where(" or ".join(f"{f} > 1" for f in fields)), "runs of one vote differ")


def exclusions(selected: DataFrame, rule_table: DataFrame) -> DataFrame:
    """(question_id, label_id, removed, no_training): selected pairs with the audited rules applied."""
    r = rule_table.select("question_id", "label_id", "action")
    j = selected.join(r, ["question_id", "label_id"], "left")
    return j.withColumn("removed", F.coalesce(F.col("action") == "remove", F.lit(False))).withColumn("no_training", F.coalesce(F.max(F.col("action").isin("remove", "exclude_training")).over(Window.partitionBy("question_id")), F.lit(False))).select("question_id", "label_id", "removed", "no_training")


# --- queries ----------------------------------------------------------------------


def all_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every scored pair of question and label, whatever its rank."""
    return base.scored(s, d).select("question_id", "label_id").distinct()


def _union(s, d):
    """The original's pool: the first UNION of the sparse and of the dense list."""
    return base.rankings(s, d).where(F.col("method").isin("bm25-char", "dense") & (F.col("rk") <= UNION)).select("question_id", "label_id").distinct()


def _stub(pairs):
    tasks = pairs.withColumn("task_id", F.concat("question_id", F.lit("::"), "label_id"))
    return run(tasks, HashScorer()).select("task_id", F.round("score", 6).alias("score"), F.col("error").isNull().alias("ok"))


def q_stub(s, d):
    return _stub(all_pairs(s, d))


def q_rerank(s, d):
    return rerank(_union(s, d), HashScorer(), UNION)


def _accepted(pairs):
    """Pairs that a binary scorer accepts at the threshold, per label."""
    return run(pairs.withColumn("task_id", F.concat("question_id", F.lit("::"), "label_id")), HashScorer()).where("error is null").withColumn("score", F.round("score", 6)).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= base.MATCH).alias("accepted"))


def q_threshold(s, d):
    return _accepted(all_pairs(s, d))


def q_codes(s, d):
    return anonymous(all_pairs(s, d), "v1")


def q_resume(s, d):
    v = table(s, d, "vote_responses").where("question_id is not null and vote is not null").select(F.concat("vote", F.lit(":"), "question_id").alias("task_id"), "error")
    return resume(v.select("task_id").distinct(), v)


def q_conditions(s, d):
    t = table(s, d, "vote_responses").select(F.col("question_id").alias("task_id")).distinct()
    return under_conditions(t, ["cold:0.0:1:4", "warm:0.7:5:4:11"]).select("task_id", "condition", "temperature", "choices")


def q_verify(s, d):
    p = base.legacy(s, d)
    checks = base.scored(s, d).groupBy("question_id", "label_id").agg((F.max("score") >= base.MATCH).alias("match"))
    return verify(p, checks)


def q_exclusions(s, d):
    """Retired labels as audited removals of legacy pairs."""
    own = table(s, d, "label_units").select("question_id", F.explode("legacy_knw_ids").alias("r")).select("question_id", F.trim("r").alias("label_id")).where("label_id <> ''").distinct()
    gone = table(s, d, "label_catalog").where("retired_at is not null").select("label_id")
    return exclusions(own, own.join(gone, "label_id", "left_semi").withColumn("action", F.lit("remove")))


_SCORE = "sc as (select *, question_id || '::' || label_id task_id, ('0x' || left(sha256('stub:' || question_id || '::' || label_id), 8))::bigint / 4294967296.0::double score from pool)"
_ALL = f"with {base.SCORED}, pool as (select distinct question_id, label_id from scored), {_SCORE}"
_UNION = f"with {base.RANKED}, pool as (select distinct question_id, label_id from ranked where \"method\" in ('bm25-char', 'dense') and rk <= {UNION}), {_SCORE}"
_OWN = "own as (select distinct question_id, trim(r, ' ') label_id from (select question_id, unnest(legacy_knw_ids) r from label_units) where trim(r, ' ') <> '')"
QUERIES = {"stub_scorer": q_stub, "rerank_pool": q_rerank, "binary_threshold": q_threshold, "anonymous_codes": q_codes, "resume_tasks": q_resume, "experiment_conditions": q_conditions, "definition_verifier": q_verify, "audited_exclusions": q_exclusions}
ORACLES = {
    "resume_tasks": "select distinct vote || ':' || question_id task_id from vote_responses where question_id is not null and vote is not null and (vote, question_id) not in (select vote, question_id from vote_responses where coalesce(error, '') = '' and question_id is not null and vote is not null)",
    "experiment_conditions": "select distinct question_id || '@' || c task_id, c \"condition\", case c when 'cold' then 0.0 else 0.7 end::double temperature, case c when 'cold' then 1 else 5 end::int choices from vote_responses, (select unnest(['cold', 'warm']) c)",
    "definition_verifier": f"with {base.LEGACY}, {base.SCORED}, c as (select question_id, label_id, max(score) >= {base.MATCH} m from scored group by all), j as (select l.*, coalesce(m, false) kept from legacy l left join c on c.question_id = l.question_id and c.label_id = l.label_id) select *, not bool_or(kept) over (partition by question_id) all_rejected from j",
    "audited_exclusions": f"with {_OWN}, j as (select *, label_id in (select label_id from label_catalog where retired_at is not null) removed from own) select *, bool_or(removed) over (partition by question_id) no_training from j",
}
ORACLES |= {
    "stub_scorer": f"{_ALL} select task_id, round(score, 6) score, true ok from sc",
    "rerank_pool": f"{_UNION} select question_id, label_id, round(score, 6) score, row_number() over (partition by question_id order by round(sc.score, 6) desc, label_id) rk from sc qualify rk <= {UNION}",
    "binary_threshold": f"{_ALL} select label_id, count(*) n, count_if(round(score, 6) >= {base.MATCH})::bigint accepted from sc group by 1",
    "anonymous_codes": f"{_ALL} select question_id, label_id, 'C' || case when k < 10 then '0' else '' end || k code from (select *, row_number() over (partition by question_id order by sha256('v1:' || question_id || ':' || label_id), label_id) k from pool)",
}
