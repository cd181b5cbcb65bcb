"""Reports over votes, scores and reviews: agreement of majorities across models, the vote cube by label and dimension, classes of stability and
instability of labels, cumulative co-occurrence, issue flags of coverage, outcomes of reviews, ranks that selections come from.

Defined cases: a rate without a denominator is null; a question without all votes in question is left out; empty tables give no rows, or one of zeros where
the report is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import votes as V
from tagloom.operators.quality import pairs, rate
from tagloom.plans import base
from tagloom.runtime import table

def _none() -> Column:
    return F.array().cast("array<string>")


def majorities(votes: DataFrame, names: list[str], least: int) -> DataFrame:
    """(question_id, labels) of questions that all of names answered: the labels with at least `least` of them, sorted."""
    full = V.complete_keys(votes, names)
    chosen = V.consensus_at_least(votes, names, least).groupBy("question_id").agg(F.array_sort(F.collect_set("label_id")).alias("labels"))
    return full.join(chosen, "question_id", "left").select("question_id", F.coalesce("labels", _none()).alias("labels"))


def cross_model(votes: DataFrame) -> DataFrame:
    """(relation, questions, qwen_empty, ds_empty, both_unanimous): how the second model's majority stands to the first's."""
    same = lambda n: (F.col(n[0]) == F.col(n[1])) & (F.col(n[1]) == F.col(n[2]))
    one = V._sets(votes, V.QWEN + V.DS).select("question_id", (same(V.QWEN) & same(V.DS)).alias("u"))
    j = one.join(majorities(votes, V.QWEN, 2).withColumnRenamed("labels", "a"), "question_id").join(majorities(votes, V.DS, 2).withColumnRenamed("labels", "b"), "question_id")
    return j.groupBy(X.change("a", "b").alias("relation")).agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.size("a") == 0).alias("qwen_empty"), F.count_if(F.size("b") == 0).alias("ds_empty"), F.count_if("u").alias("both_unanimous"))


def cube_by_label(cube: DataFrame, dims: list[str]) -> DataFrame:
    """(label_id, q, d, dim, value, exposures): each label's cells over all its exposures and by each dimension, in one pass with grouping sets."""
    keys = ["label_id", "q", "d"]
    sets = [keys, *[[*keys, x] for x in dims]]
    g = cube.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, *dims]])
    which = F.lit("all")
    for x in dims:
        which = F.when(F.grouping(x) == 0, x).otherwise(which)
    return g.agg(F.count(F.lit(1)).alias("exposures"), which.alias("dim")).select(*keys, "dim", F.coalesce(*[F.col(x).cast("string") for x in dims]).alias("value"), "exposures")


def stability_class(sets: list[str]) -> Column:
    """identical, one_off (all but one agree), majority, split (no set more than once) or divided."""
    a = F.array(*sets)
    most = F.array_max(F.transform(a, lambda x: F.size(F.filter(a, lambda y: y == x))))
    n = len(sets)
    return F.when(most == n, "identical").when(most == n - 1, "one_off").when(most * 2 > n, "majority").when(most == 1, "split").otherwise("divided")


def label_instability(votes: DataFrame, names: list[str]) -> DataFrame:
    """(label_id, chosen, unstable, instability, in_unstable, conditional): questions where a vote chose the label, those where not all did, and the same among
    questions whose label sets differ."""
    whole = votes.join(V.complete_keys(votes, names), "question_id", "left_semi").where(F.col("vote").isin(names))
    forms = whole.groupBy("question_id").agg((F.count_distinct("labels") > 1).alias("differs"))
    s = V.support(whole, names).join(forms, "question_id").withColumn("u", F.col("support") < F.col("n_votes"))
    n, u = F.count(F.lit(1)), F.count_if("u")
    return s.groupBy("label_id").agg(n.alias("chosen"), u.alias("unstable"), rate(u, n).alias("instability"), F.count_if("differs").alias("in_unstable"), rate(u, F.count_if("differs")).alias("conditional"))


#: The edges of the issue flags and of a stable label.
FLAGS = {"low_sample": 50, "long_tail": 300, "judged": 30, "low_match": 0.55, "high_zero": 0.30, "gray": 0.15, "each_type": 10, "gap": 0.20, "very_high": 0.90, "stable_match": 0.70, "stable_zero": 0.15, "stable_gray": 0.10}


def coverage_issues(planned: DataFrame, scores: DataFrame, kinds: DataFrame) -> DataFrame:
    """(label_id, planned, completed, match_rate, zero_rate, gray_rate, gap, flags, grade) per label.

    planned: (question_id, label_id) pairs that are to be scored; scores: (question_id, label_id, score); kinds: (question_id, unit_type). gap is the match rate of standalone
    questions less that of sub-questions; flags are joined by | in their order."""
    j = planned.join(scores, ["question_id", "label_id"], "left").join(kinds, "question_id", "left")
    hit, done = F.col("score") >= base.MATCH, F.col("score").isNotNull()
    of = lambda kind: (F.count_if(done & (F.col("unit_type") == kind)), F.count_if(hit & (F.col("unit_type") == kind)))
    (sn, sm), (tn, tm) = of("standalone"), of("sub_question")
    g = j.groupBy("label_id").agg(
        F.count(F.lit(1)).alias("planned"), F.count("score").alias("completed"), rate(F.count_if(hit), F.count("score")).alias("match_rate"), rate(F.count_if(F.col("score") == 0), F.count("score")).alias("zero_rate"),
        rate(F.count_if((F.col("score") >= 0.40) & (F.col("score") < base.MATCH)), F.count("score")).alias("gray_rate"), sn.alias("_sn"), tn.alias("_tn"), F.round(F.round(F.try_divide(sm, sn), 6) - F.round(F.try_divide(tm, tn), 6), 6).alias("gap"),
    )
    judged = F.col("completed") >= FLAGS["judged"]
    complete = F.col("completed") == F.col("planned")
    union = (F.col("_sn") >= FLAGS["each_type"]) & (F.col("_tn") >= FLAGS["each_type"]) & (F.col("gap") >= FLAGS["gap"])
    low, zero, gray = judged & (F.col("match_rate") < FLAGS["low_match"]), judged & (F.col("zero_rate") >= FLAGS["high_zero"]), judged & (F.col("gray_rate") >= FLAGS["gray"])
    named = [
        (~complete, "incomplete"), (F.col("planned") < FLAGS["low_sample"], "low_sample"), (F.col("planned") < FLAGS["long_tail"], "long_tail"), (low, "low_positive_coverage"), (zero, "high_zero_rate"),
        (gray, "boundary_gray"), (union, "parent_union_suspected"), (judged & (F.col("match_rate") >= FLAGS["very_high"]), "very_high_acceptance"),
    ]
    flags = F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in named])), "|")
    stable = (F.col("planned") >= FLAGS["low_sample"]) & (F.col("match_rate") >= FLAGS["stable_match"]) & (F.col("zero_rate") <= FLAGS["stable_zero"]) & (F.col("gray_rate") <= FLAGS["stable_gray"])
    grade = F.when(complete & (F.col("planned") < FLAGS["long_tail"]), "long_tail").when(~complete, "incomplete").when(union | zero, "other_issue").when(low | gray, "needs_diagnosis").when(stable, "stable").otherwise("minor")
    return g.select("label_id", "planned", "completed", "match_rate", "zero_rate", "gray_rate", "gap", flags.alias("flags"), grade.alias("grade"))


def review_outcomes(votes: DataFrame, models: list[str]) -> DataFrame:
    """(vote, outcome, questions, selected, confirmed, wrong_rate): each model's labels of a question beside the union of the reviewers', by how they stand to it."""
    rev = votes.where(F.col("vote").startswith("rev")).groupBy("question_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("r"))
    j = votes.where(F.col("vote").isin(models)).join(rev, "question_id")
    outcome = (
        F.when((F.size("labels") == 0) & (F.size("r") == 0), "both_empty")
        .when(F.size(F.array_except("r", "labels")) + F.size(F.array_except("labels", "r")) == 0, "exact")
        .when(F.size("labels") == 0, "nothing_selected")
        .when(F.size(F.array_intersect("labels", "r")) == 0, "disjoint")
        .when(F.size(F.array_except("r", "labels")) == 0, "too_many")
        .when(F.size(F.array_except("labels", "r")) == 0, "too_few")
        .otherwise("mixed")
    )
    n, k = F.sum(F.size("labels").cast("bigint")), F.sum(F.size(F.array_intersect("labels", "r")).cast("bigint"))
    return j.groupBy("vote", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("questions"), n.alias("selected"), k.alias("confirmed"), rate(n - k, F.when(n > 0, n)).alias("wrong_rate"))


# --- queries ----------------------------------------------------------------------


def _cube(s: SparkSession, d: str) -> DataFrame:
    cube = V.vote_cube(base.latest_votes(s, d), V._exposed(s, d))
    u = table(s, d, "label_units").select("question_id", "unit_type", F.coalesce(F.col("flags.parent_context_missing") | F.col("flags.image_context_missing"), F.lit(False)).alias("context_missing"))
    old = base.legacy(s, d).withColumn("legacy", F.lit(True))
    cube = cube.join(u, "question_id", "left").join(old, ["question_id", "label_id"], "left")
    return cube.select("question_id", "label_id", "q", "d", F.coalesce("unit_type", F.lit("unknown")).alias("unit_type"), F.coalesce("context_missing", F.lit(False)).alias("context_missing"), X.rank_band("rk").alias("band"), F.coalesce("legacy", F.lit(False)).alias("legacy"), F.when(F.col("rk").isNull(), "votes_only").otherwise("retrieved").alias("source"))


def q_cross_model(s: SparkSession, d: str) -> DataFrame:
    return cross_model(base.latest_votes(s, d))


def q_cube_by_label(s, d):
    return cube_by_label(_cube(s, d), ["unit_type", "context_missing", "band", "legacy", "source"])


def q_stability(s, d):
    names = V.QWEN + V.DS
    return V._sets(base.latest_votes(s, d), names).groupBy(stability_class(names).alias("class")).agg(F.count(F.lit(1)).alias("questions"))


def q_instability(s, d):
    return label_instability(base.latest_votes(s, d), V.QWEN + V.DS)


def q_cumulative(s, d):
    """Of each label that all six votes chose, the ten labels most often beside it with their share and the share up to each."""
    c = V.cooccurrence(V.vote_cube(base.latest_votes(s, d), V._exposed(s, d)), 10)
    w = Window.partitionBy("anchor").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("cumulative", F.round(F.sum("share").over(w), 5))


def q_issues(s, d):
    return coverage_issues(base.legacy(s, d), pairs(s, d), table(s, d, "label_units").select("question_id", "unit_type"))


def q_outcomes(s, d):
    return review_outcomes(base.latest_votes(s, d), base.MODEL_VOTES)


def q_rank_usage(s, d):
    """From which ranks of the hybrid list each vote's labels come; unknown stands for labels that weren't listed."""
    e = base.latest_votes(s, d).select("question_id", "vote", F.explode("labels").alias("label_id"))
    return e.join(V._hybrid(s, d), ["question_id", "label_id"], "left").groupBy("vote", X.rank_band("rk").alias("band")).agg(F.count(F.lit(1)).alias("n"))


_SIX = V._IN(V.QWEN + V.DS)
_MJ = lambda names, n: f"{n} as (select f.question_id, coalesce(list_sort(list(label_id) filter (label_id is not null)), []) l from full6 f left join (select question_id, label_id from (select question_id, vote, unnest(labels) label_id from votes where vote in {V._IN(names)}) group by 1, 2 having count(*) >= 2) x on x.question_id = f.question_id group by 1)"
_SETS = "six as (select question_id, list(labels) s, " + ", ".join(f"max(labels) filter (vote = '{v}') {v}" for v in V.QWEN + V.DS) + f" from votes where vote in {_SIX} and question_id in (select question_id from full6) group by 1)"
_BAND = "case when rk is null or rk < 1 then 'unknown' when rk <= 5 then '1-5' when rk <= 10 then '6-10' when rk <= 25 then '11-25' else '26+' end"
_DIMS = ["unit_type", "context_missing", "band", "legacy", "source"]
_CUBE5 = f"""{V._CUBE}, {base.LEGACY}, c5 as (select c.question_id, c.label_id, q, d, coalesce(unit_type, 'unknown') unit_type, coalesce(flags.parent_context_missing or flags.image_context_missing, false) context_missing, {_BAND} band, l.label_id is not null legacy, case when rk is null then 'votes_only' else 'retrieved' end source
  from cube6 c left join label_units u on u.question_id = c.question_id left join legacy l on l.question_id = c.question_id and l.label_id = c.label_id)"""
QUERIES = {
    "cross_model_votes": q_cross_model, "vote_cube_by_label": q_cube_by_label, "stability_classes": q_stability, "label_instability": q_instability, "anchor_cumulative": q_cumulative, "coverage_issues": q_issues, "review_outcomes": q_outcomes, "rank_usage": q_rank_usage,
}
ORACLES = {
    "cross_model_votes": f"{V._W}, {V._ALL6}, {_SETS}, {_MJ(V.QWEN, 'ma')}, {_MJ(V.DS, 'mb')} select {V._REL('ma.l', 'mb.l')} relation, count(*) questions, count_if(len(ma.l) = 0)::bigint qwen_empty, count_if(len(mb.l) = 0)::bigint ds_empty, count_if(qwen1 = qwen2 and qwen2 = qwen3 and ds1 = ds2 and ds2 = ds3)::bigint both_unanimous from six join ma on ma.question_id = six.question_id join mb on mb.question_id = six.question_id group by 1",
    "vote_cube_by_label": f"{_CUBE5} select label_id, q, d, 'all' dim, null \"value\", count(*) exposures from c5 group by all " + " ".join(f"union all select label_id, q, d, '{x}', {x}::varchar, count(*) from c5 group by all" for x in _DIMS),
    "stability_classes": f"{V._W}, {V._ALL6}, {_SETS}, m as (select list_max(list_transform(s, lambda x: len(list_filter(s, lambda y: y = x)))) most from six) select case when most = 6 then 'identical' when most = 5 then 'one_off' when most = 4 then 'majority' when most = 1 then 'split' else 'divided' end \"class\", count(*) questions from m group by 1",
    "label_instability": f"{V._W}, {V._ALL6}, {_SETS}, su as (select question_id, label_id, count(*) support from (select question_id, unnest(labels) label_id from votes where vote in {_SIX} and question_id in (select question_id from full6)) group by all), j as (select su.*, len(list_distinct(s)) > 1 differs from su join six on six.question_id = su.question_id) select label_id, count(*) chosen, count_if(support < 6)::bigint unstable, round(count_if(support < 6) / count(*), 6) instability, count_if(differs)::bigint in_unstable, round(count_if(support < 6) / nullif(count_if(differs), 0), 6) \"conditional\" from j group by 1",
    "anchor_cumulative": f"{V._CUBE}, a as (select question_id, label_id anchor from cube6 where q = 3 and d = 3), n as (select anchor, label_id other, count(*) n from a join cube6 c on c.question_id = a.question_id and c.label_id <> anchor where q + d > 0 group by all), r as (select *, row_number() over (partition by anchor order by n desc, other) rk, round(n / sum(n) over (partition by anchor), 6) \"share\" from n) select anchor, other, n, rk, \"share\", round(sum(\"share\") over (partition by anchor order by rk), 5) cumulative from r where rk <= 10",
    "coverage_issues": f"""with {base.SCORED}, pairs as (select question_id, label_id, max(score) score from scored group by all), {base.LEGACY}, g as (select l.label_id, count(*) planned, count(score) completed, round(count_if(score >= 0.7) / nullif(count(score), 0), 6) match_rate, round(count_if(score = 0) / nullif(count(score), 0), 6) zero_rate, round(count_if(score >= 0.4 and score < 0.7) / nullif(count(score), 0), 6) gray_rate,
  count(score) filter (unit_type = 'standalone') sn, count(score) filter (unit_type = 'sub_question') tn, round(round(count(*) filter (unit_type = 'standalone' and score >= 0.7) / nullif(count(score) filter (unit_type = 'standalone'), 0), 6) - round(count(*) filter (unit_type = 'sub_question' and score >= 0.7) / nullif(count(score) filter (unit_type = 'sub_question'), 0), 6), 6) gap
  from legacy l left join pairs p on p.question_id = l.question_id and p.label_id = l.label_id left join label_units u on u.question_id = l.question_id group by 1),
f as (select *, completed >= 30 j, coalesce(sn >= 10 and tn >= 10 and gap >= 0.2, false) un from g)
select label_id, planned, completed, match_rate, zero_rate, gray_rate, gap, array_to_string(list_filter([case when completed < planned then 'incomplete' end, case when planned < 50 then 'low_sample' end, case when planned < 300 then 'long_tail' end, case when j and match_rate < 0.55 then 'low_positive_coverage' end, case when j and zero_rate >= 0.3 then 'high_zero_rate' end, case when j and gray_rate >= 0.15 then 'boundary_gray' end, case when un then 'parent_union_suspected' end, case when j and match_rate >= 0.9 then 'very_high_acceptance' end], lambda x: x is not null), '|') flags,
  case when completed = planned and planned < 300 then 'long_tail' when completed < planned then 'incomplete' when un or (j and zero_rate >= 0.3) then 'other_issue' when j and (match_rate < 0.55 or gray_rate >= 0.15) then 'needs_diagnosis' when planned >= 50 and match_rate >= 0.7 and zero_rate <= 0.15 and gray_rate <= 0.1 then 'stable' else 'minor' end grade from f""",
    "review_outcomes": f"{V._W}, rv as (select question_id, list_distinct(flatten(list(labels))) r from votes where vote like 'rev%' group by 1), j as (select vote, labels l, r, len(list_intersect(labels, r)) k from votes v join rv on rv.question_id = v.question_id where vote in {V._IN(base.MODEL_VOTES)}) select vote, case when len(l) = 0 and len(r) = 0 then 'both_empty' when k = len(l) and k = len(r) then 'exact' when len(l) = 0 then 'nothing_selected' when k = 0 then 'disjoint' when k = len(r) then 'too_many' when k = len(l) then 'too_few' else 'mixed' end outcome, count(*) questions, sum(len(l))::bigint selected, sum(k)::bigint confirmed, round((sum(len(l)) - sum(k)) / nullif(sum(len(l)), 0), 6) wrong_rate from j group by all",
    "rank_usage": f"{V._W}, {base.RANKED}, hy as (select question_id, label_id, rk from ranked where \"method\" = 'hybrid' and rk <= 25), e as (select question_id, vote, unnest(labels) label_id from votes) select vote, {_BAND} band, count(*) n from e left join hy on hy.question_id = e.question_id and hy.label_id = e.label_id group by all",
}
