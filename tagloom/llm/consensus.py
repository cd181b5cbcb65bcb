"""Consensus from several annotators' labels.

Ballots: the latest usable row of each (question, annotator); an annotator selects a label if more than half of the row's
readable choices do. Items are all (question, label) pairs, with the labels that anybody ever selected; an item that nobody selected is a no of every
annotator of the question. Such items are only counted (questions * labels), never made, and rows exist for selected items.

Triplet moments: over the items that three annotators i, j, k met, c(i,j) is their agreement rate corrected for chance (the covariance of their ballots) and
t the third central moment. If ballots are independent given the truth, with p the share of true items and J = true-positive minus false-positive
rate, c(i,j) = p(1-p) J_i J_j and t = p(1-p)(1-2p) J_i J_j J_k. So t / sqrt(c(i,j) c(i,k) c(j,k)) gives p, and c(i,j) c(i,k) / c(j,k) = p(1-p) J_i^2 gives J_i.
The prior is the median over triplets, J the median over an annotator's triplets, which keeps a few dependent annotators from spoiling
it. J, the prior and the selection rate give both rates, these the log-odds weights, and an item's ballots add up to its score. No majority is used.

Sizes: every three annotators of a question are a triplet, so a question of m ballots has m * (m - 1) * (m - 2) / 6 of them, added up over questions by annotators; none is left out.
A question of up to BLOCK ballots is one row. A wider one is parted by a hash of the annotator into blocks of about BLOCK ballots, and each three blocks (repeated ones too) are a row, so a row
holds about 3 * BLOCK ballots however many annotators a question has. Ballots are masks of 64 labels, a row more for each further 64 labels of a question. Medians over more than
MAX_VALUES triplets are found by counting in bins and sorting the middle bin only, else in memory. A table of annotators is broadcast if it has at most MAX_BROADCAST rows (counted), else joined by shuffle with salted keys.

Defined cases: rows with an error, without choices or with unreadable choices only are no ballots; null choices are none, null and
repeated ids in a choice are ignored, an empty choice is a choice; ties in seq go by the choices' order in sorting; rows with null
question, annotator or seq are ignored; without a usable triplet (fewer than three annotators, no agreement beyond chance) J is UNKNOWN and the prior the mean
selection rate; annotators are taken to be better than chance unless most of their covariances are negative; an empty table gives no row."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import HOT_KEYS, salted_join, table, written

MAX_BROADCAST = 100_000
BLOCK = 32  # ballots in a block
MAX_VALUES = 500_000
EDGE = 1e-4  # rates stay this far from 0 and 1
UNKNOWN = 0.5  # J where it can't be estimated


def ballots(votes: DataFrame) -> DataFrame:
    """(question_id, vote, labels): the counting row's labels of each question and annotator."""
    readable = F.filter("choices", lambda c: c.isNotNull() & c["parse_error"].isNull())
    usable = votes.where((F.col("error").isNull() | (F.col("error") == "")) & F.col("question_id").isNotNull() & F.col("vote").isNotNull() & F.col("seq").isNotNull())
    usable = usable.select("question_id", "vote", "seq", F.transform(readable, lambda c: F.array_distinct(F.filter(F.coalesce(c["selected_label_ids"], F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("sets")).where("size(sets) > 0")
    last = usable.groupBy("question_id", "vote").agg(F.max(F.struct("seq", "sets"))["sets"].alias("sets"))
    chosen = F.filter(F.array_distinct(F.flatten("sets")), lambda x: F.size(F.filter("sets", lambda s: F.array_contains(s, x))) * 2 > F.size("sets"))
    return last.select("question_id", "vote", chosen.alias("labels"))


def items(cast: DataFrame) -> DataFrame:
    """(question_id, label_id, yes, annotators) of every label that an annotator selected."""
    n = cast.groupBy("question_id").agg(F.count(F.lit(1)).alias("annotators"))
    one = cast.select("question_id", F.explode("labels").alias("label_id")).groupBy("question_id", "label_id").agg(F.count(F.lit(1)).alias("yes"))
    return salted_join(one, n, ["question_id"])


def ranks(cast: DataFrame) -> DataFrame:
    """(vote, n, r): annotators by number of ballots; one row an annotator."""
    return cast.groupBy("vote").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "vote")))


def triplets(cast: DataFrame, order: DataFrame | None, labels: int, reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """(i, j, k, questions, cij, cik, cjk, t): second and third central moments of the ballots of every three annotators who met.

    order: ranks(cast), read only with `reach`; labels: how many labels an item can have; reach: only triplets within so many ranks, which no query asks for."""
    # Ballots go by (place, vote) in every question and block, so three annotators always come in one order.
    own = cast.select("question_id", F.pmod(F.xxhash64("vote"), F.lit(1 << 31)).alias("place"), "vote", "labels")
    width = cast.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    if (width.agg(F.max("n").alias("n")).first().n or 0) <= block:
        own = own.withColumn("b", F.lit(0)).withColumn("key", F.array(*[F.lit(0)] * 3))
    else:
        own = salted_join(own, width.select("question_id", F.ceil(F.col("n") / block).cast("int").alias("parts")), ["question_id"])
        own = own.withColumn("b", F.floor(F.col("place") * F.col("parts") / F.lit(float(1 << 31))).cast("int"))
        own = own.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("y", F.explode(F.sequence(F.col("x"), F.col("parts") - 1)))
        own = own.withColumn("key", F.sort_array(F.array("b", "x", "y")))  # the three blocks of h, u and v
    rows = own.groupBy("question_id", "key").agg(F.sort_array(F.collect_list(F.struct("place", "vote", "b", "labels"))).alias("p"))
    rows = rows.withColumn("all", F.array_distinct(F.flatten("p.labels")))
    rows = rows.select("key", "p", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("all") - 1) / 64).cast("int")))).alias("c"))
    rows = rows.select("key", "p", "c", F.slice("all", F.col("c") * 64 + 1, 64).alias("all"))
    zero = F.lit(0).cast("bigint")
    bit = lambda x: F.array_position(F.col("all"), x).cast("int")
    mask = lambda s: F.aggregate(s, zero, lambda m, x: m + F.when(bit(x) > 0, F.call_function("shiftleft", zero + 1, bit(x) - 1)).otherwise(zero))
    rows = rows.select("key", "c", F.transform("p", lambda v: F.struct(v["b"].alias("b"), F.struct(v["vote"].alias("v"), mask(v["labels"]).alias("m")).alias("o"))).alias("p"))
    of = lambda n: F.filter("p", lambda v: v["b"] == F.col("key")[n])["o"].alias(f"p{n}")
    rows = rows.select("c", *((F.col("key")[n] == F.col("key")[n + 1]).alias(f"same{n}") for n in (0, 1)), of(0), of(1), of(2))
    start = lambda n, at: F.when(F.col(f"same{n}"), at + 2).otherwise(1)  # noqa: E731  # where the next one's partners begin; `at` counts from 0
    pair = lambda h, u, at: F.struct(h["v"].alias("i"), h["m"].alias("a"), u["v"].alias("j"), u["m"].alias("b"), start(1, at).alias("at"))
    seconds = lambda h, n: F.transform(F.slice("p1", start(0, n), F.size("p1")), lambda u, m: pair(h, u, m + start(0, n) - 1))
    three = rows.select("c", "p2", F.inline(F.flatten(F.transform("p0", seconds))))
    three = three.select("c", "i", "a", "j", "b", F.inline(F.slice("p2", F.col("at"), F.size("p2"))).alias("k", "d"))
    met = lambda cols: F.sum(F.bit_count(functools.reduce(Column.bitwiseAND, map(F.col, cols))))
    common = {"x": "a", "y": "b", "z": "d", "xy": "ab", "xz": "ad", "yz": "bd", "xyz": "abd"}
    sums = three.groupBy("i", "j", "k").agg(F.sum((F.col("c") == 0).cast("bigint")).alias("questions"), *(met(v).alias(n) for n, v in common.items()))
    if reach is not None:
        for v in "ijk":
            sums = sums.join(order.select(F.col("vote").alias(v), F.col("r").alias(f"r{v}")), v)
        sums = sums.where(F.greatest("ri", "rj", "rk") - F.least("ri", "rj", "rk") <= reach)
    m = {x: F.col(x) / (F.col("questions") * F.lit(float(labels))) for x in ("x", "y", "z", "xy", "xz", "yz", "xyz")}
    third = m["xyz"] - m["xy"] * m["z"] - m["xz"] * m["y"] - m["yz"] * m["x"] + 2 * m["x"] * m["y"] * m["z"]
    return sums.select("i", "j", "k", "questions", (m["xy"] - m["x"] * m["y"]).alias("cij"), (m["xz"] - m["x"] * m["z"]).alias("cik"), (m["yz"] - m["y"] * m["z"]).alias("cjk"), third.alias("t"))


def medians(df: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """(keys, median, n): exact median of the column v, which is not negative, and number of rows.

    small: the values fit in memory. Else they are counted in bins, and only those of the bins that hold the middle are sorted."""
    if small:
        return df.groupBy(*keys).agg(F.median("v").alias("median"), F.count(F.lit(1)).alias("n"))
    binned = df.withColumn("bin", F.floor(F.least("v", F.lit(256.0)) * 16384))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto, of = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")), F.sum("n").over(Window.partitionBy(*keys))
    first, last = F.floor((F.col("of") + 1) / 2), F.floor((F.col("of") + 2) / 2)
    middle = lambda d: d.where((F.col("upto") >= first) & (F.col("upto") - F.col("n") < last))
    bins = written(middle(counts.withColumn("upto", upto).withColumn("of", of)).select(*keys, "bin", (F.col("upto") - F.col("n")).alias("before"), "of"), "bins")
    near = binned.join(F.broadcast(bins), [*keys, "bin"]) if bins.count() <= MAX_BROADCAST else salted_join(binned, bins, [*keys, "bin"])
    values = near.groupBy(*keys, "bin", "before", "of", "v").agg(F.count(F.lit(1)).alias("n"))
    values = middle(values.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("v"))))
    return values.groupBy(*keys).agg((F.min("v") * 0.5 + F.max("v") * 0.5).alias("median"), F.max("of").alias("n"))


def reliability(cast: DataFrame) -> DataFrame:
    """(vote, ballots, yes_rate, prior, triplets, informedness, tpr, fpr, accuracy, w_yes, w_no) per annotator; rates are over all items of the annotator's questions.

    triplets: those that the estimate rests on."""
    size = cast.select(F.explode("labels").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l").alias("k")).first()
    labels = max(1, size.k)
    three = written(triplets(cast, None, labels), "triplets")
    small = three.count() <= MAX_VALUES
    product = F.col("cij") * F.col("cik") * F.col("cjk")
    good = three.where(product > 0)
    skew = F.col("t") / F.sqrt(product)
    total = cast.count()
    prior = medians(good.select(((1 - skew / F.sqrt(skew * skew + 4)) / 2).alias("v")), [], small).first().median
    prior = min(max(prior if prior is not None else size.n / max(1, total * labels), EDGE), 1 - EDGE)
    sides = [("i", "cij", "cik", "cjk"), ("j", "cij", "cjk", "cik"), ("k", "cik", "cjk", "cij")]
    ends = lambda df, f: df.select(F.inline(F.array(*(F.struct(F.col(v).alias("vote"), f(F.col(x), F.col(y), F.col(z)).alias("v")) for v, x, y, z in sides))))
    size_of_j = medians(ends(good, lambda x, y, z: F.sqrt(x * y / z)), ["vote"], small).select("vote", (F.col("median") / F.sqrt(F.lit(prior * (1 - prior)))).alias("j_abs"), F.col("n").alias("triplets"))
    side = ends(three, lambda x, y, z: F.signum(x) + F.signum(y)).groupBy("vote").agg(F.when(F.sum("v") < 0, -1.0).otherwise(1.0).alias("side"))
    rates = cast.groupBy("vote").agg(F.count(F.lit(1)).alias("ballots"), (F.sum(F.size("labels")) / (F.count(F.lit(1)) * F.lit(float(labels)))).alias("yes_rate"))
    out = rates.join(size_of_j, "vote", "left").join(side, "vote", "left")
    clip = lambda c: F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), c))
    j = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col("j_abs") * F.col("side"), F.lit(UNKNOWN))))
    out = out.withColumn("informedness", j).withColumn("prior", F.lit(prior)).withColumn("triplets", F.coalesce("triplets", F.lit(0)))
    out = out.withColumn("tpr", clip(F.col("yes_rate") + (1 - F.col("prior")) * F.col("informedness"))).withColumn("fpr", clip(F.col("yes_rate") - F.col("prior") * F.col("informedness")))
    out = out.withColumn("accuracy", F.col("prior") * F.col("tpr") + (1 - F.col("prior")) * (1 - F.col("fpr")))
    return out.select("vote", "ballots", "yes_rate", "prior", "triplets", "informedness", "tpr", "fpr", "accuracy", F.log(F.col("tpr") / F.col("fpr")).alias("w_yes"), F.log((1 - F.col("tpr")) / (1 - F.col("fpr"))).alias("w_no"))


def consensus(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, annotators). labels: question_id, label_id, yes, annotators, log_odds, likely, majority.

    likely: the weighted ballots speak for the label; majority: more than half of at least three annotators chose it. An item's score is the sum of all
    its annotators' noes (one number a question) and of what each yes adds to it."""
    cast = written(ballots(votes), "ballots")
    judges = written(reliability(cast), "reliability")
    weights = judges.select("vote", "w_no", (F.col("w_yes") - F.col("w_no")).alias("gain"), F.log(F.col("prior") / (1 - F.col("prior"))).alias("w0"))
    joined = cast.join(F.broadcast(weights), "vote") if judges.count() <= MAX_BROADCAST else salted_join(cast, weights, ["vote"])
    base = joined.groupBy("question_id").agg(F.count(F.lit(1)).alias("annotators"), (F.max("w0") + F.sum("w_no")).alias("base"))
    yes = joined.select("question_id", "gain", F.explode("labels").alias("label_id")).groupBy("question_id", "label_id").agg(F.count(F.lit(1)).alias("yes"), F.sum("gain").alias("gain"))
    out = salted_join(yes, base, ["question_id"]).select("question_id", "label_id", "yes", "annotators", (F.col("base") + F.col("gain")).alias("log_odds"))
    majority: Column = (F.col("annotators") >= 3) & (F.col("yes") * 2 > F.col("annotators"))
    return out.withColumn("likely", F.col("log_odds") > 0).withColumn("majority", majority), judges


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The problem's statement decides by majority: every label that the operator scored is tested by that rule; its weights show in p6_labels."""
    labels, _ = consensus(table(spark, d, "vote_responses"))
    return labels.where("majority").select("question_id", "label_id")


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    labels, _ = consensus(table(spark, d, "vote_responses"))
    return labels.withColumn("log_odds", F.round("log_odds", 4))


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    judges = reliability(written(ballots(table(spark, d, "vote_responses")), "ballots"))
    return judges.select("vote", "ballots", "triplets", *(F.round(c, 6).alias(c) for c in ("yes_rate", "prior", "informedness", "tpr", "fpr", "accuracy", "w_yes", "w_no")))


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per question: annotators, labels and the share of agreeing pairs of ballots over its labels (null with one annotator)."""
    y, n = F.col("yes").cast("double"), F.col("annotators").cast("double")
    agree = (y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1))
    rows = items(ballots(table(spark, d, "vote_responses")))
    return rows.groupBy("question_id").agg(F.max("annotators").cast("bigint").alias("annotators"), F.count(F.lit(1)).alias("labels"), F.round(F.avg(F.when(n > 1, agree)), 6).alias("pair_agreement"))


_SQL = """with v as (select question_id, vote, seq, list_filter(choices, lambda c: c is not null and c.parse_error is null) ch from vote_responses where coalesce(error, '') = '' and question_id is not null and vote is not null and seq is not null),
l as (select question_id, vote, arg_max(ch, seq) ch from v where len(ch) > 0 group by all),
e as (select question_id, vote, len(ch) n, unnest(list_transform(ch, lambda c: list_distinct(coalesce(c.selected_label_ids, [])))) s from l),
f as (select question_id, vote, n, unnest(s) label_id from e),
k as (select question_id, vote, label_id from f where label_id is not null group by question_id, vote, label_id, n having count(*) * 2 > n),
a as (select question_id, count(*) annotators from l group by all),
i as (select k.question_id, label_id, count(*) yes, any_value(annotators) annotators from k join a on k.question_id = a.question_id group by all)"""
_JUDGES = f"""{_SQL},
lab as (select count(distinct label_id)::double n, count(*)::double selected from k),
b as (select l.question_id, l.vote, list(k.label_id) filter (k.label_id is not null) labels from l left join k on k.question_id = l.question_id and k.vote = l.vote group by all),
bb as (select question_id, vote, coalesce(labels, []) s from b),
tr as (select a.vote i, b.vote j, c.vote k, count(*) q, sum(len(a.s)) x, sum(len(b.s)) y, sum(len(c.s)) z, sum(len(list_intersect(a.s, b.s))) xy, sum(len(list_intersect(a.s, c.s))) xz, sum(len(list_intersect(b.s, c.s))) yz,
  sum(len(list_intersect(list_intersect(a.s, b.s), c.s))) xyz from bb a join bb b on a.question_id = b.question_id and a.vote < b.vote join bb c on a.question_id = c.question_id and b.vote < c.vote group by 1, 2, 3),
mo as (select i, j, k, x / (q * n) x, y / (q * n) y, z / (q * n) z, xy / (q * n) xy, xz / (q * n) xz, yz / (q * n) yz, xyz / (q * n) xyz from tr, lab),
ce as (select i, j, k, xy - x * y cij, xz - x * z cik, yz - y * z cjk, xyz - xy * z - xz * y - yz * x + 2 * x * y * z t from mo),
gd as (select *, t / sqrt(cij * cik * cjk) g from ce where cij * cik * cjk > 0),
rt as (select vote, count(*) ballots, sum(len(s)) / (count(*) * any_value(n)) yes_rate from bb, lab group by 1),
pr as (select greatest({EDGE}, least(1 - {EDGE}, coalesce((select median((1 - g / sqrt(g * g + 4)) / 2) from gd), (select any_value(selected) / (count(*) * any_value(n)) from bb, lab)))) prior),
js as (select vote, median(v) v, count(*) triplets from (select i vote, sqrt(cij * cik / cjk) v from gd union all select j, sqrt(cij * cjk / cik) from gd union all select k, sqrt(cik * cjk / cij) from gd) group by 1),
sd as (select vote, case when sum(v) < 0 then -1 else 1 end side from (select i vote, sign(cij) + sign(cik) v from ce union all select j, sign(cij) + sign(cjk) from ce union all select k, sign(cik) + sign(cjk) from ce) group by 1),
ju as (select rt.vote, ballots, yes_rate, prior, coalesce(triplets, 0) triplets, greatest(-1, least(1, coalesce(v / sqrt(prior * (1 - prior)) * side, {UNKNOWN}))) informedness from rt cross join pr left join js on js.vote = rt.vote left join sd on sd.vote = rt.vote),
jr as (select *, greatest({EDGE}, least(1 - {EDGE}, yes_rate + (1 - prior) * informedness)) tpr, greatest({EDGE}, least(1 - {EDGE}, yes_rate - prior * informedness)) fpr from ju),
jw as (select *, prior * tpr + (1 - prior) * (1 - fpr) accuracy, ln(tpr / fpr) w_yes, ln((1 - tpr) / (1 - fpr)) w_no from jr)"""
QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels, "p6_annotators": p6_annotators, "p6_agreement": p6_agreement}
ORACLES = {
    "p6_annotators": f"{_JUDGES} select vote, ballots, triplets, round(yes_rate, 6) yes_rate, round(prior, 6) prior, round(informedness, 6) informedness, round(tpr, 6) tpr, round(fpr, 6) fpr, round(accuracy, 6) accuracy, round(w_yes, 6) w_yes, round(w_no, 6) w_no from jw",
    "p6_labels": f"""{_JUDGES}, ns as (select question_id, count(*) annotators, ln(any_value(prior) / (1 - any_value(prior))) + sum(w_no) base from bb join jw using (vote) group by 1),
ys as (select k.question_id, label_id, count(*) yes, sum(w_yes - w_no) gain from k join jw on jw.vote = k.vote group by 1, 2)
select ys.question_id, label_id, yes, annotators, round(base + gain, 4) log_odds, base + gain > 0 likely, annotators >= 3 and yes * 2 > annotators majority from ys join ns on ns.question_id = ys.question_id""",
    "p6_found": f"{_SQL} select question_id, label_id from i where annotators >= 3 and yes * 2 > annotators",
    "p6_agreement": f"{_SQL} select question_id, max(annotators)::bigint annotators, count(*) labels, round(avg(case when annotators > 1 then (yes * (yes - 1) + (annotators - yes) * (annotators - yes - 1))::double / (annotators * (annotators - 1)) end), 6) pair_agreement from i group by all",
}
