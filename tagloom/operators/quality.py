"""Label quality: coverage of positives, hard negatives and confusion, boundary screens, ablations, review precision, latency and throughput.

A (question, label) pair's score is the best score over the candidates rows; a pair matches from base.MATCH on. Every rate is null
without a denominator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.plans import base
from tagloom.runtime import table

IRRELEVANT, CHANGED = 0.10, 0.20


def rate(part, whole):
    return F.round(F.try_divide(part, whole), 6)


def pairs(s: SparkSession, d: str) -> DataFrame:
    """(question_id, label_id, score): the best over all methods."""
    return base.scored(s, d).groupBy("question_id", "label_id").agg(F.max("score").alias("score"))


def coverage(scores: DataFrame) -> DataFrame:
    """Per label: pairs, matches, the sum of scores in ten-thousandths (exact in any order of adding), bands, sample tier and grade."""
    n = F.count(F.lit(1))
    m = F.count_if(F.col("score") >= base.MATCH)
    band = lambda lo, hi: F.count_if((F.col("score") >= lo) & (F.col("score") < hi))
    g = scores.groupBy("label_id").agg(n.alias("n"), m.alias("matched"), rate(m, n).alias("match_rate"), F.sum(F.round(F.col("score") * 10_000).cast("bigint")).alias("score_points"), F.percentile_approx("score", 0.5, 1_000_000).alias("median_score"), band(0.40, 0.70).alias("gray"), F.count_if(F.col("score") < IRRELEVANT).alias("irrelevant"))
    grade = F.when(F.col("n") < 30, "insufficient").when(F.col("match_rate") >= 0.8, "strong").when(F.col("match_rate") >= 0.5, "fair").when(F.col("match_rate") >= 0.2, "weak").otherwise("poor")
    return g.withColumn("tier", X.sample_tier("n")).withColumn("grade", grade)


def best_per_question(scores: DataFrame) -> DataFrame:
    return scores.groupBy("question_id").agg(F.max("score").alias("score")).groupBy(X.score_band("score").alias("band")).agg(F.count(F.lit(1)).alias("questions"))


def hard_negatives(scores: DataFrame, own: DataFrame, siblings: DataFrame) -> DataFrame:
    """(question_id, source_id, target_id, score): siblings of a question's own labels that are none of its labels, with the score that they got
    (null if never scored). own: (question_id, label_id); siblings: (label_id, sibling_id)."""
    t = own.join(siblings, "label_id").select("question_id", F.col("label_id").alias("source_id"), F.col("sibling_id").alias("target_id"))
    t = t.join(own.withColumnRenamed("label_id", "target_id"), ["question_id", "target_id"], "left_anti")
    return t.join(scores.withColumnRenamed("label_id", "target_id"), ["question_id", "target_id"], "left").select("question_id", "source_id", "target_id", "score")


def confusion(neg: DataFrame, *by: str) -> DataFrame:
    """False acceptance of hard negatives per target or per (source, target)."""
    judged, wrong = F.count("score"), F.count_if(F.col("score") >= base.MATCH)
    return neg.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), judged.alias("judged"), wrong.alias("accepted"), rate(wrong, judged).alias("false_accept")).withColumn("tier", X.false_accept_tier("false_accept"))


#: The least numbers of positives and judged negatives of a screen.
SCREEN_POSITIVES, SCREEN_NEGATIVES = 300, 20
#: Match rates from the first on are high, below the second low; false acceptance up to the third is low, above the fourth high.
HIGH_MATCH, LOW_MATCH, LOW_ACCEPT, HIGH_ACCEPT = 0.70, 0.55, 0.10, 0.15


def boundary_screen(positive: DataFrame, negative: DataFrame, positives: int = SCREEN_POSITIVES, negatives: int = SCREEN_NEGATIVES) -> DataFrame:
    """Per label: the positive match rate beside the false acceptance of negatives, and the screen that they fall in."""
    p = positive.select("label_id", F.col("n").alias("positives"), "match_rate")
    q = confusion(negative, "target_id").select(F.col("target_id").alias("label_id"), F.col("judged").alias("negatives"), "false_accept")
    j = p.join(q, "label_id", "full").withColumn("positives", F.coalesce("positives", F.lit(0))).withColumn("negatives", F.coalesce("negatives", F.lit(0)))
    match, accept = F.col("match_rate"), F.col("false_accept")
    screen = (
        F.when(F.col("positives") < positives, "few_positives")
        .when((F.col("negatives") < negatives) | accept.isNull(), "few_negatives")
        .when((match >= HIGH_MATCH) & (accept <= LOW_ACCEPT), "stable")
        .when((match < LOW_MATCH) & (accept <= LOW_ACCEPT), "narrow")
        .when((match >= HIGH_MATCH) & (accept > HIGH_ACCEPT), "broad")
        .when((match < LOW_MATCH) & (accept > HIGH_ACCEPT), "conflict")
        .otherwise("minor")
    )
    return j.withColumn("screen", screen)


def verified_negatives(scores: DataFrame, own: DataFrame, siblings: DataFrame, least: float = 0.80, n: int = 50, seed: str = "tagloom-1") -> DataFrame:
    """(target_id, question_id, sources, score): at most n hard negatives a target label, from questions that are verified positives of its siblings.

    A question is a source's verified positive if it carries the source and scored at least `least` for it, and a negative of the target if it doesn't carry that.
    Each source offers its n questions with the smallest hashes; sources take turns, a question met again adds its source (sources joined by |, score
    the largest), and the turns end with the n-th question."""
    sure = own.join(scores, ["question_id", "label_id"]).where(F.col("score") >= least)
    t = sure.join(siblings, "label_id").select("question_id", F.col("label_id").alias("source_id"), F.col("sibling_id").alias("target_id"), "score")
    t = t.join(own.select("question_id", F.col("label_id").alias("target_id")), ["question_id", "target_id"], "left_anti")
    h = X.hash_rank(seed, "target_id", "source_id", "question_id", sep=":")
    offered = t.withColumn("turn", F.row_number().over(Window.partitionBy("target_id", "source_id").orderBy(h, "question_id"))).where(F.col("turn") <= n)
    # From here on a target has at most n rows a sibling.
    met = offered.withColumn("at", F.row_number().over(Window.partitionBy("target_id").orderBy("turn", "source_id")))
    first = met.withColumn("first", F.row_number().over(Window.partitionBy("target_id", "question_id").orderBy("at")) == 1)
    nth = first.withColumn("k", F.sum(F.col("first").cast("int")).over(Window.partitionBy("target_id").orderBy("at")))
    kept = nth.where((F.col("k") < n) | ((F.col("k") == n) & F.col("first")))
    return kept.groupBy("target_id", "question_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), "|").alias("sources"), F.max("score").alias("score"))


def ablation(arms: DataFrame, a: str, b: str) -> DataFrame:
    """Per label, arm a against arm b on common pairs: flips of the match and changes of score. arms: (arm, question_id, label_id, score)."""
    one = lambda n, c: arms.where(F.col("arm") == n).select("question_id", "label_id", F.col("score").alias(c))
    j = one(a, "x").join(one(b, "y"), ["question_id", "label_id"])
    mx, my = F.col("x") >= base.MATCH, F.col("y") >= base.MATCH
    return j.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(mx & ~my).alias("lost"), F.count_if(~mx & my).alias("won"), F.count_if((mx != my) | (F.abs(F.col("x") - F.col("y")) >= CHANGED)).alias("changed"), F.sum((F.round(F.col("y") * 10_000) - F.round(F.col("x") * 10_000)).cast("bigint")).alias("delta_points"))


def repeated_ablation(arms: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """Over pairs in all four arms: robust changes are those where both runs of each side agree and the sides differ."""
    names = [*before, *after]
    w = arms.where(F.col("arm").isin(names)).groupBy("question_id", "label_id").pivot("arm", names).agg(F.max("score")).na.drop(subset=names)
    m = {n: F.col(n) >= base.MATCH for n in names}
    stable = (m[before[0]] == m[before[1]]) & (m[after[0]] == m[after[1]])
    robust = stable & (m[before[0]] != m[after[0]])
    kind = F.when(~stable, "unstable").when(~robust, "same").when(m[before[0]], "lost").otherwise("won")
    return w.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label_id").alias("labels"))


def percentile_at(values: DataFrame, by: str, col: str, shares: list[float]) -> DataFrame:
    """Nearest-rank percentiles (the ceil(n * share)-th value), mean and largest; exact."""
    p = [F.expr(f"percentile_disc({x}) within group (order by {col})").alias(f"p{round(x * 100)}") for x in shares]
    return values.groupBy(by).agg(F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"), *p, F.max(col).alias("most"))


def throughput(log: DataFrame, by: str, at: str, last: int) -> DataFrame:
    """Per key: rows, and rows an hour over its `last` latest rows (null with one instant)."""
    n = log.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    # The window is cut to `last` rows a key before the shuffle; the count has its own map-side aggregation.
    recent = log.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))).where(F.col("_n") <= last)
    g = recent.groupBy(by).agg(F.count(F.lit(1)).alias("recent"), F.min(at).alias("_a"), F.max(at).alias("_z"))
    s = (F.unix_micros(F.col("_z").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 1e6
    return n.join(g, by).withColumn("per_hour", F.round(F.try_divide((F.col("recent") - 1) * 3600, s), 4)).select(by, "n", "recent", "per_hour")


# --- queries ----------------------------------------------------------------------


def q_coverage(s: SparkSession, d: str) -> DataFrame:
    return coverage(pairs(s, d)).drop("median_score")


def q_grades(s, d):
    c = q_coverage(s, d)
    return c.groupBy("tier", "grade").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("pairs"))


def q_best(s, d):
    return best_per_question(pairs(s, d))


def q_match_rates(s, d):
    return base.scored(s, d).groupBy("method", "label_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("score") >= base.MATCH).cast("double")), 6).alias("match_rate"))


def q_bands(s, d):
    p = pairs(s, d).join(table(s, d, "label_units").select("question_id", "unit_type"), "question_id", "left")
    return p.groupBy("unit_type", X.score_band("score").alias("band"), X.bands("score", *X.SCORE_TENTHS).alias("tenth")).agg(F.count(F.lit(1)).alias("n"))


def _siblings(s, d):
    """Labels under one parent of the taxonomy."""
    c = table(s, d, "label_catalog").select("label_id", X.path_parent("label_path").alias("m"))
    return c.join(c.select(F.col("label_id").alias("sibling_id"), "m"), "m").where("label_id <> sibling_id").select("label_id", "sibling_id")


def _negatives(s, d):
    return hard_negatives(pairs(s, d), base.legacy(s, d), _siblings(s, d))


def q_negatives(s, d):
    return _negatives(s, d).distinct()


def q_confusion(s, d):
    return confusion(_negatives(s, d), "source_id", "target_id")


def q_target_confusion(s, d):
    return confusion(_negatives(s, d), "target_id")


def q_verified(s, d):
    whole = table(s, d, "label_units").where("unit_type = 'standalone'").select("question_id")
    return verified_negatives(pairs(s, d).join(whole, "question_id", "left_semi"), base.legacy(s, d), _siblings(s, d))


def q_screen(s, d, *least):
    return boundary_screen(coverage(pairs(s, d).join(base.legacy(s, d), ["question_id", "label_id"], "left_semi")), _negatives(s, d), *least)


def q_screen_small(s, d):
    """The screens of labels with few questions: from three positives and three negatives on."""
    return q_screen(s, d, 3, 3)


def q_screen_summary(s, d):
    return q_screen(s, d).groupBy("screen").agg(F.count(F.lit(1)).alias("labels"))


def _arms(s, d):
    """Retrieval versions as the arms of an ablation."""
    e = table(s, d, "candidates").select(F.col("retrieval_version").alias("arm"), "question_id", F.inline("candidates")).where("label_id is not null and score is not null and not isnan(score)")
    return e.groupBy("arm", "question_id", "label_id").agg(F.max("score").alias("score"))


def q_ablation(s, d):
    return ablation(_arms(s, d), "bm25-v1", "bm25-v2")


def q_repeated(s, d):
    return repeated_ablation(_arms(s, d), ("bm25-v1", "dense-v1"), ("bm25-v2", "dense-v3"))


def q_irrelevant(s, d):
    """Pairs with no relevance (zero) or almost none (tiny), and their share, of labels that have any."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("score") < IRRELEVANT)
    return pairs(s, d).groupBy("label_id").agg(n.alias("n"), F.count_if(F.col("score") == 0).alias("zero"), F.count_if((F.col("score") > 0) & (F.col("score") < IRRELEVANT)).alias("tiny"), bad.alias("irrelevant"), rate(bad, n).alias("share")).where("irrelevant > 0")


def _latency(s, d):
    return table(s, d, "vote_responses").where("coalesce(error, '') = '' and latency_seconds is not null")


def q_latency(s, d):
    return percentile_at(_latency(s, d), "vote", "latency_seconds", [0.5, 0.9, 0.95, 0.99])


def q_order_percentiles(s, d):
    return percentile_at(table(s, d, "orders"), "o_orderpriority", "o_totalprice", [0.25, 0.5, 0.75])


def q_throughput(s, d):
    return throughput(_latency(s, d).select("vote", "seq", "created_at").distinct(), "vote", "created_at", 50)


def q_eta(s, d):
    """Questions each vote still lacks and the hours that takes at its recent rate; the largest decides."""
    all_q = table(s, d, "vote_responses").select("question_id").distinct().count()
    done = base.latest_votes(s, d).groupBy("vote").agg(F.count(F.lit(1)).alias("done"))
    return done.join(q_throughput(s, d), "vote").select("vote", "done", (F.lit(all_q) - F.col("done")).alias("left"), "per_hour", F.round(F.try_divide(F.lit(all_q) - F.col("done"), F.col("per_hour")), 4).alias("hours"))


def q_run_report(s, d):
    v = table(s, d, "vote_responses")
    ok = F.expr("coalesce(error, '') = ''")
    bad = F.expr("coalesce(aggregate(choices, 0L, (n, c) -> n + if(c.parse_error is not null, 1L, 0L)), 0L)")
    return v.groupBy("vote").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("question_id").alias("questions"), F.count_if(ok).alias("succeeded"), F.sum(F.expr("coalesce(size(choices), 0)").cast("bigint")).alias("choices"), F.sum(bad).alias("unreadable"), F.round(F.avg("latency_seconds"), 6).alias("mean_latency"))


def q_review(s, d):
    """Review precision: of a model's labels on questions that reviewers saw, how many a reviewer chose too."""
    v = base.latest_votes(s, d)
    sel = lambda p: v.where(F.col("vote").startswith(p)).select("question_id", F.explode("labels").alias("label_id"))
    seen = v.where(F.col("vote").startswith("rev")).select("question_id").distinct()
    model = v.where(F.col("vote").isin(base.MODEL_VOTES)).join(seen, "question_id", "left_semi").select("vote", "question_id", F.explode("labels").alias("label_id"))
    right = sel("rev").distinct().withColumn("ok", F.lit(1))
    return model.join(right, ["question_id", "label_id"], "left").groupBy("vote").agg(F.count(F.lit(1)).alias("selected"), F.count("ok").alias("confirmed"), rate(F.count("ok"), F.count(F.lit(1))).alias("precision"))


def q_rare(s, d):
    """Labels that few questions carry: how often the model votes recalled and rejected them."""
    v = base.latest_votes(s, d).where(F.col("vote").isin(base.MODEL_VOTES))
    old = base.legacy(s, d)
    seen = old.join(v.select("question_id").distinct(), "question_id", "left_semi")
    rare = old.groupBy("label_id").agg(F.count(F.lit(1)).alias("carried")).where("carried <= 5")
    got = v.select("question_id", F.explode("labels").alias("label_id")).distinct().withColumn("hit", F.lit(1))
    return seen.join(rare, "label_id").join(got, ["question_id", "label_id"], "left").groupBy("label_id").agg(F.first("carried").alias("carried"), F.count(F.lit(1)).alias("voted"), F.count("hit").alias("recalled"))


def q_audit(s, d):
    """Positive and negative audit in one ledger: each label's category by coverage grade and screen, ordered by weight."""
    c = q_coverage(s, d).select("label_id", "n", "match_rate", "grade")
    j = c.join(q_screen_small(s, d).select("label_id", "screen"), "label_id", "left").join(table(s, d, "label_catalog").select("label_id", "label_name", F.col("retired_at").isNotNull().alias("retired")), "label_id")
    cat = F.when(F.col("retired"), "retired").when(F.col("grade") == "insufficient", "insufficient").when(F.col("screen") == "conflict", "redefine").when(F.col("screen") == "broad", "sharpen").when(F.col("screen") == "narrow", "widen").when(F.col("screen").isin("few_positives", "few_negatives"), "unscreened").otherwise("keep")
    return j.select("label_id", "label_name", "n", "match_rate", cat.alias("category"))


_P = f"with {base.SCORED}, pairs as (select question_id, label_id, max(score) score from scored group by all)"
_COV = f"""cov as (select *, case when n < 30 then 'LT1' when n < 100 then 'LT2' when n < 300 then 'LT3' when n < 500 then 'ADEQUATE' else 'CAPPED' end tier, case when n < 30 then 'insufficient' when match_rate >= 0.8 then 'strong' when match_rate >= 0.5 then 'fair' when match_rate >= 0.2 then 'weak' else 'poor' end grade from
(select label_id, count(*) n, count_if(score >= {base.MATCH})::bigint matched, round(count_if(score >= {base.MATCH}) / count(*), 6) match_rate, sum(round(score * 10000)::bigint)::bigint score_points, count_if(score >= 0.4 and score < 0.7)::bigint gray, count_if(score < {IRRELEVANT})::bigint irrelevant from {{}} group by 1))"""
_BAND = "case when score = 0 then 'zero' when score < 0.4 then 'weak_related' when score < 0.7 then 'gray' when score < 0.8 then 'borderline_match' else 'high_match' end"
_NEG = f"""{_P}, {base.LEGACY}, up as (select label_id, coalesce(array_to_string(list_slice(string_split(label_path, '->'), 1, -2), '->'), '') parent from label_catalog),
sib as (select a.label_id, b.label_id sibling_id from up a join up b on a.parent = b.parent and a.label_id <> b.label_id),
neg as (select l.question_id, l.label_id source_id, sibling_id target_id, p.score from legacy l join sib s on s.label_id = l.label_id left join pairs p on p.question_id = l.question_id and p.label_id = sibling_id where (l.question_id, sibling_id) not in (select question_id, label_id from legacy))"""
_CONF = lambda by: f"select *, case when false_accept is null then null when false_accept <= 0.05 then 'low' when false_accept <= 0.15 then 'moderate' when false_accept <= 0.3 then 'high' else 'very_high' end tier from (select {by}, count(*) tasks, count(score) judged, coalesce(count_if(score >= {base.MATCH}), 0)::bigint accepted, round(coalesce(count_if(score >= {base.MATCH}), 0) / nullif(count(score), 0), 6) false_accept from neg group by all)"
_SCREEN = f"""{_NEG}, own as (select p.* from pairs p join legacy l on p.question_id = l.question_id and p.label_id = l.label_id), {_COV.format('own')}, cf as ({_CONF('target_id')}),
sc as (select coalesce(cov.label_id, target_id) label_id, coalesce(n, 0) positives, match_rate, coalesce(judged, 0) negatives, false_accept from cov full join cf on cov.label_id = target_id),
screen as (select *, case when positives < {{positives}} then 'few_positives' when negatives < {{negatives}} or false_accept is null then 'few_negatives' when match_rate >= 0.7 and false_accept <= 0.1 then 'stable' when match_rate < 0.55 and false_accept <= 0.1 then 'narrow'
  when match_rate >= 0.7 and false_accept > 0.15 then 'broad' when match_rate < 0.55 and false_accept > 0.15 then 'conflict' else 'minor' end screen from sc)"""
_SCREEN, _SMALL = (_SCREEN.replace("{positives}", p).replace("{negatives}", q) for p, q in (("300", "20"), ("3", "3")))
_ARMS = "with e as (select retrieval_version arm, question_id, unnest(candidates) c from candidates), arms as (select arm, question_id, c.label_id label_id, max(c.score) score from e where c.label_id is not null and c.score is not null and not isnan(c.score) group by all)"
_LATN = "(select * from vote_responses where coalesce(error, '') = '' and latency_seconds is not null)"
_THR = f"thr as (select vote, count(*) n, count_if(k <= 50)::bigint recent, round((count_if(k <= 50) - 1) * 3600 / nullif(epoch_us(max(created_at)) / 1e6 - epoch_us(min(case when k <= 50 then created_at end)) / 1e6, 0), 4) per_hour from (select *, row_number() over (partition by vote order by created_at desc) k from (select distinct vote, seq, created_at from {_LATN})) group by 1)"

QUERIES = {
    "coverage_metrics": q_coverage, "coverage_grades": q_grades, "best_score_bands": q_best, "match_rates": q_match_rates, "score_bands": q_bands, "hard_negatives": q_negatives, "confusion_pairs": q_confusion, "target_confusion": q_target_confusion,
    "boundary_screen": q_screen, "boundary_screen_small": q_screen_small, "verified_negatives": q_verified, "boundary_screen_summary": q_screen_summary, "ablation_flips": q_ablation, "ablation_robust": q_repeated, "irrelevant_share": q_irrelevant, "latency_percentiles": q_latency, "order_percentiles": q_order_percentiles,
    "throughput": q_throughput, "throughput_eta": q_eta, "run_report": q_run_report, "review_precision": q_review, "rare_labels": q_rare, "label_audit": q_audit,
}
ORACLES = {
    "coverage_metrics": f"{_P}, {_COV.format('pairs')} select * from cov",
    "coverage_grades": f"{_P}, {_COV.format('pairs')} select tier, grade, count(*) labels, sum(n)::bigint pairs from cov group by all",
    "best_score_bands": f"{_P}, b as (select max(score) score from pairs group by question_id) select {_BAND} band, count(*) questions from b group by 1",
    "match_rates": f"with {base.SCORED} select \"method\", label_id, count(*) n, round(avg((score >= {base.MATCH})::int), 6) match_rate from scored group by all",
    "score_bands": f"{_P} select unit_type, {_BAND} band, case " + " ".join(f"when score < {k / 10} then '{(k - 1) / 10:.1f}-{k / 10:.1f}'" for k in range(1, 9)) + " else '0.8-1.0' end tenth, count(*) n from pairs p left join label_units u on u.question_id = p.question_id group by all",
    "hard_negatives": f"{_NEG} select distinct * from neg",
    "confusion_pairs": f"{_NEG} {_CONF('source_id, target_id')}",
    "target_confusion": f"{_NEG} {_CONF('target_id')}",
    "boundary_screen": f"{_SCREEN} select * from screen",
    "boundary_screen_small": f"{_SMALL} select * from screen",
    "verified_negatives": f"""{_NEG}, sure as (select l.question_id, l.label_id source_id, p.score from legacy l join pairs p on p.question_id = l.question_id and p.label_id = l.label_id where p.score >= 0.8 and l.question_id in (select question_id from label_units where unit_type = 'standalone')),
of as (select question_id, source_id, sibling_id target_id, score from sure join sib on sib.label_id = source_id where (question_id, sibling_id) not in (select question_id, label_id from legacy)),
tu as (select *, row_number() over (partition by target_id, source_id order by sha256('tagloom-1:' || target_id || ':' || source_id || ':' || question_id), question_id) turn from of),
po as (select *, row_number() over (partition by target_id order by turn, source_id) pos from tu where turn <= 50),
fi as (select *, min(pos) over (partition by target_id, question_id) f from po),
ends as (select target_id, coalesce(max(f) filter (n = 50), max(f) + 1000000000) stop from (select target_id, f, row_number() over (partition by target_id order by f) n from (select distinct target_id, f from fi)) group by 1)
select fi.target_id, question_id, array_to_string(list_sort(list(distinct source_id)), '|') sources, max(score) score from fi join ends on ends.target_id = fi.target_id where pos <= stop group by 1, 2""",
    "boundary_screen_summary": f"{_SCREEN} select screen, count(*) labels from screen group by 1",
    "ablation_flips": f"{_ARMS} select x.label_id, count(*) n, count_if(x.score >= 0.7 and y.score < 0.7)::bigint lost, count_if(x.score < 0.7 and y.score >= 0.7)::bigint won, count_if((x.score >= 0.7) <> (y.score >= 0.7) or abs(x.score - y.score) >= {CHANGED})::bigint changed, sum(round(y.score * 10000)::bigint - round(x.score * 10000)::bigint)::bigint delta_points from arms x join arms y on x.question_id = y.question_id and x.label_id = y.label_id where x.arm = 'bm25-v1' and y.arm = 'bm25-v2' group by 1",
    "ablation_robust": f"{_ARMS}, w as (select question_id, label_id, max(score) filter (arm = 'bm25-v1') >= 0.7 a, max(score) filter (arm = 'dense-v1') >= 0.7 b, max(score) filter (arm = 'bm25-v2') >= 0.7 c, max(score) filter (arm = 'dense-v3') >= 0.7 e from arms group by all) select case when a <> b or c <> e then 'unstable' when a = c then 'same' when a then 'lost' else 'won' end kind, count(*) n, count(distinct label_id) labels from w where a is not null and b is not null and c is not null and e is not null group by 1",
    "irrelevant_share": f"{_P} select label_id, count(*) n, count_if(score = 0)::bigint zero, count_if(score > 0 and score < 0.1)::bigint tiny, count_if(score < 0.1)::bigint irrelevant, round(count_if(score < 0.1) / count(*), 6) share from pairs group by 1 having count_if(score < 0.1) > 0",
    "latency_percentiles": f"select vote, count(latency_seconds) n, round(avg(latency_seconds), 6) mean, quantile_disc(latency_seconds, 0.5) p50, quantile_disc(latency_seconds, 0.9) p90, quantile_disc(latency_seconds, 0.95) p95, quantile_disc(latency_seconds, 0.99) p99, max(latency_seconds) most from {_LATN} group by 1",
    "order_percentiles": "select o_orderpriority, count(o_totalprice) n, round(avg(o_totalprice), 6) mean, quantile_disc(o_totalprice, 0.25) p25, quantile_disc(o_totalprice, 0.5) p50, quantile_disc(o_totalprice, 0.75) p75, max(o_totalprice) most from orders group by 1",
    "throughput": f"with {_THR} select * from thr",
    "throughput_eta": f"with {base.VOTES}, {_THR}, q as (select count(distinct question_id) n from vote_responses), dn as (select vote, count(*) done from votes group by 1) select vote, done, q.n - done \"left\", per_hour, round((q.n - done) / nullif(per_hour, 0), 4) \"hours\" from dn join thr using (vote), q",
    "run_report": "select vote, count(*) n_rows, count(distinct question_id) questions, count_if(coalesce(error, '') = '')::bigint succeeded, sum(coalesce(len(choices), 0))::bigint choices, sum(coalesce(len(list_filter(choices, lambda c: c.parse_error is not null)), 0))::bigint unreadable, round(avg(latency_seconds), 6) mean_latency from vote_responses group by 1",
    "review_precision": f"with {base.VOTES}, rv as (select distinct question_id, label_id from (select question_id, unnest(labels) label_id from votes where vote like 'rev%')), m as (select vote, question_id, unnest(labels) label_id from votes where vote not like 'rev%' and question_id in (select question_id from votes where vote like 'rev%')) select vote, count(*) selected, count(r.label_id) confirmed, round(count(r.label_id) / count(*), 6) \"precision\" from m left join rv r on r.question_id = m.question_id and r.label_id = m.label_id group by 1",
    "rare_labels": f"with {base.VOTES}, {base.LEGACY}, r as (select label_id, count(*) carried from legacy group by 1 having count(*) <= 5), g as (select distinct question_id, label_id from (select question_id, unnest(labels) label_id from votes where vote not like 'rev%')) select l.label_id, any_value(carried) carried, count(*) voted, count(g.label_id) recalled from legacy l join r on r.label_id = l.label_id left join g on g.question_id = l.question_id and g.label_id = l.label_id where l.question_id in (select question_id from votes where vote not like 'rev%') group by 1",
    "label_audit": f"{_SMALL}, {_COV.format('pairs').replace('cov as', 'cov2 as')} select c.label_id, label_name, n, c.match_rate, case when retired_at is not null then 'retired' when grade = 'insufficient' then 'insufficient' when screen = 'conflict' then 'redefine' when screen = 'broad' then 'sharpen' when screen = 'narrow' then 'widen' when screen in ('few_positives', 'few_negatives') then 'unscreened' else 'keep' end category from cov2 c left join screen s on s.label_id = c.label_id join label_catalog k on k.label_id = c.label_id",
}
