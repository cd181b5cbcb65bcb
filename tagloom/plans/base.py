"""The project's base relations, and the same relations as common table expressions for the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import table

MODEL_VOTES = ["qwen1", "qwen2", "qwen3", "ds1", "ds2", "ds3"]
#: A candidate counts as matched from this score on.
MATCH = 0.70


def living_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_catalog").where("retired_at is null")


def legacy(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, label_id): distinct legacy labels that are living."""
    own = table(spark, d, "label_units").select("question_id", F.explode("legacy_knw_ids").alias("r")).select("question_id", F.trim("r").alias("label_id"))
    return own.join(living_labels(spark, d).select("label_id"), "label_id", "left_semi").select("question_id", "label_id").distinct()


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, method, label_id, score): the best score of each candidate; null labels and scores and NaN are left out."""
    e = table(spark, d, "candidates").select("question_id", "method", F.inline("candidates")).where("label_id is not null and score is not null and not isnan(score)")
    return e.groupBy("question_id", "method", "label_id").agg(F.max("score").alias("score"))


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """scored with `rk`, the rank within question and method by score, then label id."""
    w = Window.partitionBy("question_id", "method").orderBy(F.desc("score"), "label_id")
    return scored(spark, d).withColumn("rk", F.row_number().over(w))


def latest_votes(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, vote, labels, n_choices, seq): the latest success of each key and the labels that most of its choices selected, sorted."""
    v = table(spark, d, "vote_responses").where("coalesce(error, '') = ''")
    v = v.select("question_id", "vote", "seq", F.expr("transform(filter(choices, c -> c is not null and c.parse_error is null), c -> array_distinct(filter(coalesce(c.selected_label_ids, cast(array() as array<string>)), x -> x is not null)))").alias("sets")).where("size(sets) > 0")
    last = v.groupBy("question_id", "vote").agg(F.max(F.struct("seq", "sets")).alias("s")).select("question_id", "vote", "s.seq", "s.sets")
    most = F.expr("array_sort(filter(array_distinct(flatten(sets)), x -> size(filter(sets, s -> array_contains(s, x))) >= floor(size(sets) / 2) + 1))")
    return last.select("question_id", "vote", most.alias("labels"), F.size("sets").cast("bigint").alias("n_choices"), "seq")


LEGACY = """living as (select * from label_catalog where retired_at is null),
legacy as (select distinct question_id, trim(r, ' ') label_id from (select question_id, unnest(legacy_knw_ids) r from label_units) where trim(r, ' ') in (select label_id from living))"""
SCORED = """cand as (select question_id, "method", unnest(candidates) c from candidates),
scored as (select question_id, "method", c.label_id label_id, max(c.score) score from cand where c.label_id is not null and c.score is not null and not isnan(c.score) group by all)"""
RANKED = f"""{SCORED},
ranked as (select *, row_number() over (partition by question_id, "method" order by score desc, label_id) rk from scored)"""
VOTES = """vok as (select question_id, vote, seq, list_filter(choices, lambda c: c is not null and c.parse_error is null) ch from vote_responses where coalesce(error, '') = ''),
vlast as (select question_id, vote, max(seq) seq, arg_max(ch, seq) ch from vok where len(ch) > 0 group by all),
vsel as (select question_id, vote, len(ch) n, unnest(ch) c from vlast),
vlab as (select question_id, vote, n, unnest(list_distinct(c.selected_label_ids)) label_id from vsel),
vmaj as (select question_id, vote, label_id from vlab where label_id is not null group by question_id, vote, n, label_id having count(*) >= n // 2 + 1),
votes as (select l.question_id, l.vote, len(l.ch) n_choices, l.seq, coalesce(list_sort(list(m.label_id) filter (m.label_id is not null)), []) labels
  from vlast l left join vmaj m on l.question_id = m.question_id and l.vote = m.vote group by all)"""


def counting(sql: str) -> str:
    """sql with each count_if(x) as a filtered count, which is 0 and not null where no x is true."""
    out, rest = "", sql
    while (at := rest.find("count_if(")) >= 0:
        start, depth, quoted = at + len("count_if("), 1, False
        end = start
        while depth:
            ch = rest[end]
            quoted ^= ch == "'"
            depth += (not quoted) * ((ch == "(") - (ch == ")"))
            end += 1
        out += rest[:at] + "(count(*) filter (where " + counting(rest[start : end - 1]) + "))"
        rest = rest[end:]
    return out + rest
