"""Review packages and second looks: model texts of units and labels, candidate signatures, judges' decisions, agreement within a row's choices,
ablation samples, paired snapshots, frozen inputs of a next stage, teacher packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import quality as Q
from tagloom.operators import sampling as P
from tagloom.operators import votes as V
from tagloom.plans import base
from tagloom.plans import scoring as S
from tagloom.runtime import assert_empty, table

#: What the model's texts are made of, with the most characters of each field.
LABEL_TEXT = [("知识点名称：", "label_name", 50), ("知识点路径：", "label_path", 100), ("定义：", "definition", 120), ("核心概念：", "core_concepts", 130), ("易混淆边界：", "distinctions", 80)]
UNIT_TEXT = [("当前题干：", "stem", 260), ("答案：", "answer_text", 100), ("解析：", "analysis", 240), ("选项：", "options", 120), ("父题公共材料（仅作语境）：", "parent_stem", 100)]


def label_text() -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(h), F.left(X.path_text(c) if c == "label_path" else X.text(c), F.lit(n))) for h, c, n in LABEL_TEXT])


def unit_text() -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(h), X.head_tail(c, n)) for h, c, n in UNIT_TEXT])


def candidate_signature(pairs: DataFrame, seed: str) -> DataFrame:
    """(question_id, signature): a hash of each question's candidates in the order that a model sees them."""
    e = pairs.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(X.hash_rank(seed, "question_id", "label_id", sep=":").alias("h"), "label_id"))).alias("c"))
    return e.select("question_id", F.sha2(F.array_join(F.transform("c", lambda s: s["label_id"]), "\n"), 256).alias("signature"))


def co_label_decision(target_in: Column, source_in: Column, valid: Column) -> Column:
    """What a judge who may select any of target and sources says about the pair."""
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "unresolved")
        .when(target_in & source_in, "reasonable_co_label")
        .when(~target_in & source_in, "target_too_broad")
        .when(target_in, "source_insufficient")
        .otherwise("neither_sufficient")
    )


def corrected_screen(summary: DataFrame) -> DataFrame:
    """False acceptance with the judge's view: only targets that are too broad are errors; unresolved tasks are not judged."""
    err = F.col("target_too_broad")
    return summary.withColumn("corrected", Q.rate(err, F.col("rejected") + err)).withColumn("tier", X.false_accept_tier("corrected"))


def within_choices(log: DataFrame) -> DataFrame:
    """(question_id, vote, seq, n, forms, mean_jaccard): agreement among the readable choices of one row; null with one choice."""
    sets = F.expr("transform(filter(choices, c -> c is not null and c.parse_error is null), c -> array_sort(array_distinct(filter(coalesce(c.selected_label_ids, cast(array() as array<string>)), x -> x is not null))))")
    r = log.where("coalesce(error, '') = ''").select("question_id", "vote", "seq", sets.alias("s")).where("size(s) > 0").distinct()
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b, k: k > i), lambda b: X.jaccard(a, b))))
    mean = F.when(F.size(pairs) > 0, F.round(F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y) / F.size(pairs), 6))
    return r.select("question_id", "vote", "seq", F.size("s").cast("bigint").alias("n"), F.size(F.array_distinct("s")).cast("bigint").alias("forms"), mean.alias("mean_jaccard"))


def frozen(inputs: DataFrame, path: str) -> DataFrame:
    """The inputs of a next stage, written once; a second call with other inputs is an error."""
    from tagloom.runtime import exists
    from tagloom.sources.sinks import fingerprint, publish

    spark = inputs.sparkSession
    folder, _, name = path.rpartition("/")
    if not exists(spark, folder, name):
        publish(inputs, f"{path}.parquet", "parquet")
    stored = spark.read.parquet(f"{path}.parquet")
    if fingerprint(stored) != fingerprint(inputs):
        raise ValueError("the stage's inputs differ from those it was frozen with")
    return stored


def recover(wanted: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Rows of a snapshot by key; a missing or repeated key is an error."""
    assert_empty(wanted.join(snapshot, key, "left_anti").select(key), "key missing in the snapshot")
    found = snapshot.join(wanted.select(key).distinct(), key, "left_semi")
    assert_empty(found.groupBy(key).count().where("count > 1"), "repeated key in the snapshot")
    return found


# --- queries ----------------------------------------------------------------------


def q_label_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "label_catalog").select("label_id", label_text().alias("body"))


def q_unit_text(s, d):
    return table(s, d, "label_units").select("question_id", unit_text().alias("body"))


def q_signature(s, d):
    return candidate_signature(S.all_pairs(s, d), "v1")


def q_judge(s, d):
    """Judge summaries per target: reviewers as judges of hard negatives, their labels as what they selected."""
    rev = base.latest_votes(s, d).where("vote like 'rev%'").select("question_id", "vote", "labels")
    t = Q._negatives(s, d).select("question_id", "source_id", "target_id").distinct().join(rev, "question_id")
    dec = co_label_decision(F.array_contains("labels", F.col("target_id")), F.array_contains("labels", F.col("source_id")), F.size("labels") > 0)
    kinds = ["unresolved", "reasonable_co_label", "target_too_broad", "source_insufficient", "neither_sufficient"]
    return t.withColumn("decision", dec).groupBy("target_id").pivot("decision", kinds).count().na.fill(0, kinds)


def q_corrected(s, d):
    c = Q.confusion(Q._negatives(s, d), "target_id").select("target_id", (F.col("judged") - F.col("accepted")).alias("rejected"))
    return corrected_screen(q_judge(s, d).select("target_id", "target_too_broad").join(c, "target_id"))


def q_choices(s, d):
    return within_choices(table(s, d, "vote_responses"))


def q_choice_summary(s, d):
    c = q_choices(s, d).where("n > 1")
    return c.groupBy("vote", "n").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("forms") == 1).alias("identical"), F.sum(F.round(F.col("mean_jaccard") * 1_000_000).cast("bigint")).alias("jaccard_millionths"))


def q_flags(s, d):
    """Reasons for a second look at a unit: sorted set of flags from the unit and its votes."""
    u = table(s, d, "label_units").select("question_id", "flags", F.trim(X.text("stem")).alias("stem"), F.trim(X.text("analysis")).alias("analysis"))
    v = base.latest_votes(s, d).where(F.col("vote").isin(base.MODEL_VOTES)).groupBy("question_id").agg(F.count_distinct("labels").alias("forms"), F.max(F.size("labels")).alias("most"))
    j = u.join(v, "question_id", "left")
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(F.col("flags.parent_context_missing"), "parent_context_missing"), F.when(F.col("flags.image_context_missing"), "image_context_missing"), F.when(F.col("stem") == "", "blank_stem"), F.when(F.col("analysis") == "", "blank_analysis"),
        F.when(F.col("forms") > 1, "votes_differ"), F.when(F.col("most") == 0, "no_label"),
    )))
    return j.select("question_id", F.array_join(reasons, "|").alias("reasons")).where("reasons <> ''")


def q_flips(s, d):
    """Direction of each pair's match from one retrieval version to the next."""
    a = Q._arms(s, d)
    one = lambda n, c: a.where(F.col("arm") == n).select("question_id", "label_id", (F.col("score") >= base.MATCH).alias(c))
    j = one("bm25-v1", "x").join(one("bm25-v2", "y"), ["question_id", "label_id"])
    way = F.when(F.col("x") & F.col("y"), "stay_match").when(F.col("x"), "match_to_no_match").when(F.col("y"), "no_match_to_match").otherwise("stay_no_match")
    return j.groupBy(way.alias("way")).agg(F.count(F.lit(1)).alias("n"))


def q_ablation_sample(s, d):
    """Pairs for an ablation: of each band 50 by hash, pairs of both versions first, each under both conditions."""
    a = Q._arms(s, d).where(F.col("arm").isin("bm25-v1", "bm25-v2")).groupBy("question_id", "label_id").agg(F.count(F.lit(1)).alias("arms"), F.max("score").alias("score"))
    r = a.withColumn("pair_id", F.concat("question_id", F.lit("::"), "label_id")).withColumn("band", X.score_band("score"))
    w = Window.partitionBy("band").orderBy(F.desc("arms"), X.hash_rank("ablation", "pair_id"), "pair_id")
    picked = r.withColumn("pick", F.row_number().over(w).cast("bigint")).where("pick <= 50")
    return picked.select("pair_id", "band", "pick", F.explode(F.array(F.lit("name_only"), F.lit("with_card"))).alias("condition"))


def q_unstable(s, d):
    """200 questions whose votes differ, by hash."""
    p = V.q_patterns(s, d).where("forms > 1").withColumn("_all", F.lit("all"))
    return P.bottom_k(p, ["_all"], "question_id", 200, "unstable").select("question_id", "forms")


def q_snapshot(s, d):
    """Paired snapshot: questions that both first votes answered, with both label sets."""
    v = base.latest_votes(s, d)
    one = lambda n, c: v.where(F.col("vote") == n).select("question_id", F.array_join("labels", "|").alias(c))
    return one("qwen1", "qwen_labels").join(one("ds1", "ds_labels"), "question_id")


def q_next_stage(s, d):
    """Who goes to a third vote: within a model the label sets differ; across models both agree within and differ."""
    v = V._sets(base.latest_votes(s, d), ["qwen1", "qwen2", "ds1", "ds2"])
    q, e = F.col("qwen1") != F.col("qwen2"), F.col("ds1") != F.col("ds2")
    stage = F.when(q & e, "both_models").when(q, "qwen3").when(e, "ds3").when(F.col("qwen1") != F.col("ds1"), "arbitrate").otherwise("done")
    return v.select("question_id", stage.alias("stage"))


def q_teacher(s, d):
    """Teacher package: labels with a matching problem, of each five pairs at even places of the score and six in turns of the bands."""
    bad = Q.q_coverage(s, d).where("match_rate < 0.65").select("label_id")
    p = P._scores(s, d).join(bad, "label_id", "left_semi")
    a = P.quantile_sample(p, "label_id", ["score", "pair_id"], 5).select("label_id", "pair_id", F.lit("quantile").alias("via"))
    b = P.round_robin(p, "label_id", "band", "pair_id", 6).select("label_id", "pair_id", F.lit("turns").alias("via"))
    return a.unionByName(b)


def q_pattern_package(s, d):
    """Review package by vote pattern: of each cell of the cube ten exposures by hash, with the unit's text."""
    cube = V.vote_cube(base.latest_votes(s, d), V._exposed(s, d)).withColumn("pair_id", F.concat("question_id", F.lit("::"), "label_id"))
    r = P.bottom_k(cube, ["q", "d"], "pair_id", 10, "pattern")
    u = table(s, d, "label_units").select("question_id", F.left(X.text("stem"), F.lit(80)).alias("head"))
    return r.join(u, "question_id", "left").select("q", "d", "pair_id", F.col("pick").cast("bigint").alias("pick"), "head")


def q_greedy(s, d):
    """A stress sample that prefers rare labels."""
    pool = base.legacy(s, d).groupBy("question_id").agg(F.collect_set("label_id").alias("tags"))
    picks = P.greedy_rare(pool, "question_id", "tags", 50)
    return s.createDataFrame([(q, i) for i, q in enumerate(picks, 1)], "question_id string, pick long")


def q_coarse(s, d):
    """Coarse recall by a scorer: every candidate under a code, the scorer's choice decoded to label ids."""
    codes = S.anonymous(S.all_pairs(s, d), "v1")
    tasks = codes.withColumn("task_id", F.concat("question_id", F.lit("::"), "label_id"))
    best = S.run(tasks, S.HashScorer("coarse")).where("score >= 0.5").groupBy("question_id").agg(F.collect_list("code").alias("selected"))
    return S.decode(best, codes).select("question_id", F.array_join("selected", "|").alias("selected"), "unknown", "need_expand")


def q_set_algebra(s, d):
    """Per question: legacy and majority labels in both, in either only, and whether one holds the other."""
    none = F.array().cast("array<string>")
    old = base.legacy(s, d).groupBy("question_id").agg(F.array_sort(F.collect_set("label_id")).alias("o"))
    new = V._majority(s, d).groupBy("question_id").agg(F.array_sort(F.collect_set("label_id")).alias("n"))
    j = new.join(old, "question_id", "left").withColumn("o", F.coalesce("o", none))
    join = lambda c: F.array_join(F.array_sort(c), "|")
    return j.select("question_id", join(F.array_intersect("o", "n")).alias("common"), join(F.array_except("o", "n")).alias("old_only"), join(F.array_except("n", "o")).alias("new_only"), (F.size(F.array_except("n", "o")) == 0).alias("is_within"))


_CH = f"""wc as (select distinct question_id, vote, seq, list_transform(list_filter(choices, lambda c: c is not null and c.parse_error is null), lambda c: list_sort(list_distinct(coalesce(c.selected_label_ids, [])))) s from vote_responses where coalesce(error, '') = ''),
wp as (select question_id, vote, seq, s, len(s) n, unnest(flatten([[[i, k] for k in range(i + 1, len(s) + 1)] for i in range(1, len(s) + 1)])) p from wc where len(s) > 0),
wj as (select question_id, vote, seq, s, avg(case when len(s[p[1]]) + len(s[p[2]]) = 0 then 1.0 else len(list_intersect(s[p[1]], s[p[2]])) / (len(s[p[1]]) + len(s[p[2]]) - len(list_intersect(s[p[1]], s[p[2]]))) end) m from wp group by all),
ch as (select c.question_id, c.vote, c.seq, len(c.s)::bigint n, len(list_distinct(c.s))::bigint forms, round(m, 6) mean_jaccard from wc c left join wj on wj.question_id = c.question_id and wj.vote = c.vote and wj.seq = c.seq and wj.s = c.s where len(c.s) > 0)"""
_JUDGE = f"""{Q._NEG}, {base.VOTES}, jd as (select distinct n.question_id, source_id, target_id, vote, case when len(labels) = 0 then 'unresolved' when list_contains(labels, target_id) and list_contains(labels, source_id) then 'reasonable_co_label' when list_contains(labels, source_id) then 'target_too_broad' when list_contains(labels, target_id) then 'source_insufficient' else 'neither_sufficient' end decision from neg n join votes v on v.question_id = n.question_id where vote like 'rev%'),
judge as (select target_id, count_if(decision = 'unresolved')::bigint unresolved, count_if(decision = 'reasonable_co_label')::bigint reasonable_co_label, count_if(decision = 'target_too_broad')::bigint target_too_broad, count_if(decision = 'source_insufficient')::bigint source_insufficient, count_if(decision = 'neither_sufficient')::bigint neither_sufficient from jd group by 1)"""
_CLIP = lambda c, n: f"case when length(coalesce({c}, '')) > {n} then left({c}, {max(1, n // 3)}) || '…[中间省略]…' || right({c}, {n - max(1, n // 3)}) else coalesce({c}, '') end"

QUERIES = {
    "dense_label_text": q_label_text, "dense_unit_text": q_unit_text, "candidate_signature": q_signature, "judge_summary": q_judge, "corrected_boundary": q_corrected, "choice_agreement": q_choices, "choice_agreement_summary": q_choice_summary, "quality_reasons": q_flags,
    "flip_direction": q_flips, "ablation_sample": q_ablation_sample, "unstable_sample": q_unstable, "paired_snapshot": q_snapshot, "next_stage": q_next_stage, "teacher_package": q_teacher, "pattern_package": q_pattern_package, "greedy_stress_sample": q_greedy, "coarse_recall": q_coarse, "set_algebra": q_set_algebra,
}
ORACLES = {
    "dense_unit_text": "select question_id, concat_ws(chr(10), " + ", ".join(f"'{h}' || {_CLIP(c, n)}" for h, c, n in UNIT_TEXT) + ") body from label_units",
    "judge_summary": f"{_JUDGE} select * from judge",
    "corrected_boundary": f"{_JUDGE}, cf as ({Q._CONF('target_id')}) select *, case when corrected is null then null when corrected <= 0.05 then 'low' when corrected <= 0.15 then 'moderate' when corrected <= 0.3 then 'high' else 'very_high' end tier from (select j.target_id, target_too_broad, judged - accepted rejected, round(target_too_broad / nullif(judged - accepted + target_too_broad, 0), 6) corrected from judge j join cf on cf.target_id = j.target_id)",
    "choice_agreement": f"with {_CH} select * from ch",
    "choice_agreement_summary": f"with {_CH} select vote, n, count(*) n_rows, count_if(forms = 1)::bigint identical, sum(round(mean_jaccard * 1000000)::bigint)::bigint jaccard_millionths from ch where n > 1 group by all",
    "quality_reasons": f"with {base.VOTES}, v as (select question_id, count(distinct labels) forms, max(len(labels)) most from votes where vote in {V._IN(base.MODEL_VOTES)} group by 1), r as (select u.question_id, array_to_string(list_sort(list_filter([case when flags.parent_context_missing then 'parent_context_missing' end, case when flags.image_context_missing then 'image_context_missing' end, case when trim(coalesce(stem, ''), ' ') = '' then 'blank_stem' end, case when trim(coalesce(analysis, ''), ' ') = '' then 'blank_analysis' end, case when forms > 1 then 'votes_differ' end, case when most = 0 then 'no_label' end], lambda x: x is not null)), '|') reasons from label_units u left join v on v.question_id = u.question_id) select * from r where reasons <> ''",
    "flip_direction": f"{Q._ARMS} select case when x.score >= 0.7 and y.score >= 0.7 then 'stay_match' when x.score >= 0.7 then 'match_to_no_match' when y.score >= 0.7 then 'no_match_to_match' else 'stay_no_match' end way, count(*) n from arms x join arms y on x.question_id = y.question_id and x.label_id = y.label_id where x.arm = 'bm25-v1' and y.arm = 'bm25-v2' group by 1",
    "ablation_sample": f"{Q._ARMS}, a as (select question_id || '::' || label_id pair_id, count(*) arms, max(score) score from arms where arm in ('bm25-v1', 'bm25-v2') group by 1), b as (select *, {Q._BAND} band from a), p as (select *, row_number() over (partition by band order by arms desc, sha256('ablation' || chr(0) || pair_id), pair_id) pick from b qualify pick <= 50) select pair_id, band, pick, unnest(['name_only', 'with_card']) \"condition\" from p",
    "unstable_sample": f"{V._PAIR}, f as (select question_id, count(distinct labels) forms from v6 group by 1 having count(distinct labels) > 1) select * from f order by sha256('unstable' || chr(0) || question_id), question_id limit 200",
    "paired_snapshot": f"with {base.VOTES} select x.question_id, array_to_string(x.labels, '|') qwen_labels, array_to_string(y.labels, '|') ds_labels from votes x join votes y on x.question_id = y.question_id and x.vote = 'qwen1' and y.vote = 'ds1'",
    "next_stage": f"with {base.VOTES}, w as (select question_id, max(labels) filter (vote = 'qwen1') a, max(labels) filter (vote = 'qwen2') b, max(labels) filter (vote = 'ds1') c, max(labels) filter (vote = 'ds2') e from votes group by 1) select question_id, case when a <> b and c <> e then 'both_models' when a <> b then 'qwen3' when c <> e then 'ds3' when a <> c then 'arbitrate' else 'done' end stage from w where a is not null and b is not null and c is not null and e is not null",
    "teacher_package": f"{P._S}, bad as (select label_id from p group by 1 having round(count_if(score >= {base.MATCH}) / count(*), 6) < 0.65), pp as (select * from p where label_id in (select label_id from bad)), r as (select *, row_number() over (partition by label_id order by score, pair_id) - 1 i, count(*) over (partition by label_id) n from pp), tn as (select *, row_number() over (partition by label_id, band order by {P._H('pair_id')}, pair_id) turn from pp), u as (select *, row_number() over (partition by label_id order by turn, band, pair_id) pick from tn) select label_id, pair_id, 'quantile' via from r where n <= 5 or i in (select round_even(k * (n - 1) / 4.0, 0) from (select unnest(range(5)) k)) union all select label_id, pair_id, 'turns' from u where pick <= 6",
    "set_algebra": f"{V._RS}, j as (select ns.question_id, coalesce(o, []) o, n from ns left join os on os.question_id = ns.question_id) select question_id, array_to_string(list_sort(list_intersect(o, n)), '|') common, array_to_string(list_sort(list_filter(o, lambda x: not list_contains(n, x))), '|') old_only, array_to_string(list_sort(list_filter(n, lambda x: not list_contains(o, x))), '|') new_only, len(list_filter(n, lambda x: not list_contains(o, x))) = 0 is_within from j",
    "pattern_package": f"{V._CUBE}, p as (select *, question_id || '::' || label_id pair_id from cube6), r as (select *, row_number() over (partition by q, d order by sha256('pattern' || chr(0) || pair_id), pair_id) pick from p qualify pick <= 10) select q, d, pair_id, pick, left(coalesce(stem, ''), 80) head from r left join label_units u on u.question_id = r.question_id",
}
ORACLES["dense_label_text"] = "select label_id, concat_ws(chr(10), " + ", ".join(f"'{h}' || left(replace(coalesce({c}, ''), {chr(39)}->{chr(39)}, {chr(39)}{'@' if c == 'label_path' else '->'}{chr(39)}), {n})" for h, c, n in LABEL_TEXT) + ") body from label_catalog"
ORACLES["candidate_signature"] = f"with {base.SCORED}, p as (select distinct question_id, label_id from scored) select question_id, sha256(string_agg(label_id, chr(10) order by sha256('v1:' || question_id || ':' || label_id), label_id)) signature from p group by 1"
_COARSE = f"""with {base.SCORED}, p as (select distinct question_id, label_id from scored),
k as (select *, row_number() over (partition by question_id order by sha256('v1:' || question_id || ':' || label_id), label_id) n, ('0x' || left(sha256('coarse:' || question_id || '::' || label_id), 8))::bigint / 4294967296.0::double score from p)"""
ORACLES["coarse_recall"] = f"{_COARSE} select question_id, array_to_string(list_sort(list(label_id)), '|') selected, 0::bigint unknown, false need_expand from k where score >= 0.5 group by 1"
