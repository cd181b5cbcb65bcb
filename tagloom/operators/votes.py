"""Votes: latest success per key, majorities, strict intersections, routes of disagreement, the vote cube, set comparison and stability.

A missing vote is not a negative one: cubes and comparisons use only questions that all votes in question have answered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.plans import base
from tagloom.runtime import table

QWEN, DS = ["qwen1", "qwen2", "qwen3"], ["ds1", "ds2", "ds3"]


def latest_success(log: DataFrame, keys: list[str], seq: str, ok: str) -> DataFrame:
    """The row of each key with the largest seq among those where `ok` (SQL) holds; errors never replace a success."""
    cols = [c for c in log.columns if c not in keys]
    best = log.where(ok).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(seq, F.xxhash64(*[F.col(c).cast("string") for c in cols if dict(log.dtypes)[c] in ("string", "bigint", "int", "double")]))).alias("_r"))
    return best.select(*keys, "_r.*")


def prefer_success(log: DataFrame, keys: list[str], seq: str, ok: str) -> DataFrame:
    """The latest success of each key, or its latest row if it has none."""
    cols = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*cols, F.expr(ok).alias("success")), F.struct(F.expr(ok), F.col(seq))).alias("_r")).select(*keys, "_r.*")


def complete_keys(votes: DataFrame, names: list[str]) -> DataFrame:
    """question_ids that all of `names` answered."""
    return votes.where(F.col("vote").isin(names)).groupBy("question_id").agg(F.count_distinct("vote").alias("n")).where(F.col("n") == len(names)).select("question_id")


def support(votes: DataFrame, names: list[str]) -> DataFrame:
    """(question_id, label_id, support, n_votes): how many of the named votes that a question has chose each label."""
    v = votes.where(F.col("vote").isin(names))
    n = v.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_votes"))
    return v.select("question_id", F.explode("labels").alias("label_id")).groupBy("question_id", "label_id").agg(F.count(F.lit(1)).alias("support")).join(n, "question_id")


def consensus_at_least(votes: DataFrame, names: list[str], least: int) -> DataFrame:
    s = support(votes, names)
    return s.where(F.col("support") >= least)


def strict_intersection(votes: DataFrame, names: list[str]) -> DataFrame:
    """Labels with the support of all votes the question has, and those withdrawn for lack of one."""
    return support(votes, names).withColumn("kept", F.col("support") == F.col("n_votes"))


def _sets(votes: DataFrame, names: list[str]) -> DataFrame:
    """One row a question with all named votes: a column of labels a vote (one aggregation, no chain of joins)."""
    v = votes.where(F.col("vote").isin(names)).groupBy("question_id").agg(*[F.max(F.when(F.col("vote") == n, F.col("labels"))).alias(n) for n in names])
    return v.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))


def adaptive_route(votes: DataFrame, a: str, b: str) -> DataFrame:
    """(question_id, relation, needs_more): whether two votes differ, so that a further one is due."""
    return _sets(votes, [a, b]).select("question_id", X.change(a, b).alias("relation"), (F.col(a) != F.col(b)).alias("needs_more"))


def vote_cube(votes: DataFrame, ranked: DataFrame, q: list[str] = QWEN, ds: list[str] = DS) -> DataFrame:
    """(question_id, label_id, rk, q, d): for each candidate of a completely voted question, how many votes of either model chose it."""
    v = votes.join(complete_keys(votes, q + ds), "question_id", "left_semi").where(F.col("vote").isin(q + ds))
    chosen = v.select("question_id", F.explode("labels").alias("label_id"), F.col("vote").isin(q).alias("is_q")).groupBy("question_id", "label_id").agg(F.count_if(F.expr("is_q")).alias("q"), F.count_if(~F.col("is_q")).alias("d"))
    seen = ranked.join(v.select("question_id").distinct(), "question_id", "left_semi")
    return seen.join(chosen, ["question_id", "label_id"], "left").select("question_id", "label_id", "rk", F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("d", F.lit(0)).alias("d"))


def cube_slices(cube: DataFrame, dims: list[str]) -> DataFrame:
    """Counts of each (q, d) cell over all exposures and by each dimension alone, in one pass with grouping sets."""
    sets = [["q", "d"], *[["q", "d", x] for x in dims]]
    g = cube.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in ["q", "d", *dims]])
    which = F.lit("all")
    for x in dims:
        which = F.when(F.grouping(x) == 0, x).otherwise(which)
    return g.agg(F.count(F.lit(1)).alias("exposures"), which.alias("dim"), *[F.grouping(x).alias(f"_{x}") for x in dims]).select("q", "d", "dim", F.coalesce(*[F.col(x).cast("string") for x in dims]).alias("value"), "exposures")


def cooccurrence(cube: DataFrame, top: int) -> DataFrame:
    """For labels chosen by all six votes: the `top` labels that others chose beside them, with counts and share."""
    anchor = cube.where("q = 3 and d = 3").select("question_id", F.col("label_id").alias("anchor"))
    other = cube.where("q + d > 0").select("question_id", F.col("label_id").alias("other"))
    n = anchor.join(other, "question_id").where("anchor <> other").groupBy("anchor", "other").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rk", F.expr("row_number() over (partition by anchor order by n desc, other)").cast("bigint")).withColumn("share", F.round(F.expr("n / sum(n) over (partition by anchor)"), 6)).where(F.col("rk") <= top)


def pairwise(votes: DataFrame, names: list[str]) -> DataFrame:
    """(question_id, a, b, jaccard, same) for every two of the named votes, of questions that have them all."""
    v = votes.where(F.col("vote").isin(names)).join(complete_keys(votes, names), "question_id", "left_semi").select("question_id", "vote", "labels")
    w = v.select("question_id", F.col("vote").alias("b"), F.col("labels").alias("lb"))
    return v.withColumnRenamed("vote", "a").join(w, "question_id").where("a < b").select("question_id", "a", "b", F.round(X.jaccard("labels", "lb"), 6).alias("jaccard"), (F.col("labels") == F.col("lb")).alias("same"))


def compare_with_legacy(units: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(question_id, unit_type, n_old, n_new, relationship): old and new are (question_id, label_id); questions of new only."""
    sets = lambda df, c: df.groupBy("question_id").agg(F.array_sort(F.collect_set("label_id")).alias(c))
    none = F.array().cast("array<string>")
    j = new.select("question_id").distinct().join(units.select("question_id", "unit_type"), "question_id").join(sets(old, "o"), "question_id", "left").join(sets(new.where("label_id is not null"), "n"), "question_id", "left")
    j = j.withColumn("o", F.coalesce("o", none)).withColumn("n", F.coalesce("n", none))
    return j.select("question_id", "unit_type", F.size("o").cast("bigint").alias("n_old"), F.size("n").cast("bigint").alias("n_new"), X.relationship("o", "n").alias("relationship"))


def parent_rollup(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """(parent_id, label_id, sources, children, done): union of the children's labels with the children that have each. chosen: (question_id, label_id or null)."""
    kids = plan.where("deleted_at is null").select(F.col("question_id").alias("parent_id"), F.explode("child_question_ids").alias("question_id")).where("question_id is not null").distinct()
    done = chosen.select("question_id").distinct().withColumn("_d", F.lit(True))
    state = kids.join(done, "question_id", "left").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"), F.count("_d").alias("done"))
    rows = kids.join(chosen.where("label_id is not null"), "question_id").groupBy("parent_id", "label_id").agg(F.array_join(F.array_sort(F.collect_set("question_id")), "|").alias("sources"))
    return rows.join(state, "parent_id").withColumn("complete", F.col("done") == F.col("children"))


# --- queries ----------------------------------------------------------------------


def _v(s, d):
    return base.latest_votes(s, d)


def _hybrid(s, d):
    return base.rankings(s, d).where("method = 'hybrid' and rk <= 25").select("question_id", "label_id", "rk")


def _exposed(s, d):
    """The candidates of each question, with every label that a vote chose appended."""
    voted = _v(s, d).where(F.col("vote").isin(QWEN + DS)).select("question_id", F.explode("labels").alias("label_id")).distinct()
    seen = _hybrid(s, d)
    more = voted.join(seen, ["question_id", "label_id"], "left_anti").withColumn("rk", F.lit(None).cast("int"))
    return seen.unionByName(more)


def _majority(s, d):
    """(question_id, label_id or null): labels of at least two of three votes of the first model; a null label marks a question without one."""
    v = _v(s, d).where(F.col("vote").isin(QWEN))
    c = consensus_at_least(_v(s, d), QWEN, 2).select("question_id", "label_id")
    return v.select("question_id").distinct().join(c, "question_id", "left")


def q_latest(s: SparkSession, d: str) -> DataFrame:
    return _v(s, d).select("question_id", "vote", F.array_join("labels", "|").alias("labels"), "n_choices", "seq")


def q_prefer(s, d):
    log = table(s, d, "vote_responses").select("question_id", "vote", "seq", "error", "attempts").distinct()
    return prefer_success(log, ["question_id", "vote"], "seq", "coalesce(error, '') = ''").select("question_id", "vote", "seq", "success")


def q_attempts(s, d):
    v = table(s, d, "vote_responses")
    return v.groupBy("vote").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.expr("coalesce(error, '') <> ''")).alias("errors"), F.sum("attempts").alias("attempts"), F.max("attempts").cast("bigint").alias("most_attempts"), F.round(F.try_divide(F.count_if(F.expr("coalesce(error, '') <> ''")), F.count(F.lit(1))), 6).alias("error_rate"))


def q_error_kinds(s, d):
    kind = F.regexp_extract("error", r"^([^:]+)", 1)
    return table(s, d, "vote_responses").where("coalesce(error, '') <> ''").groupBy(kind.alias("kind"), "vote").agg(F.count(F.lit(1)).alias("n"))


def q_pending(s, d):
    """Keys still to be run on resume: seen, without a success."""
    log = table(s, d, "vote_responses").select("question_id", "vote").distinct()
    return log.join(_v(s, d), ["question_id", "vote"], "left_anti")


def q_majority(s, d):
    return consensus_at_least(_v(s, d), QWEN, 2)


def q_strict(s, d):
    return strict_intersection(_v(s, d), QWEN + DS)


def q_consensus_per_model(s, d):
    v = _v(s, d)
    one = lambda names, m: consensus_at_least(v, names, 2).withColumn("model", F.lit(m))
    return one(QWEN, "qwen").unionByName(one(DS, "ds"))


def q_route(s, d):
    return adaptive_route(_v(s, d), "qwen1", "ds1")


def q_complete(s, d):
    return complete_keys(_v(s, d), QWEN + DS)


def q_cube(s, d):
    return vote_cube(_v(s, d), _exposed(s, d)).groupBy("q", "d").agg(F.count(F.lit(1)).alias("exposures"), F.count_distinct("label_id").alias("labels"))


def q_cube_slices(s, d):
    cube = vote_cube(_v(s, d), _exposed(s, d)).join(table(s, d, "label_units").select("question_id", "unit_type"), "question_id", "left")
    return cube_slices(cube.withColumn("band", X.rank_band("rk")).withColumn("unit_type", F.coalesce("unit_type", F.lit("unknown"))), ["unit_type", "band", "label_id"])


def q_cooccurrence(s, d):
    return cooccurrence(vote_cube(_v(s, d), _exposed(s, d)), 5)


def q_pairwise(s, d):
    return pairwise(_v(s, d), QWEN + DS)


def q_pairwise_summary(s, d):
    within = F.left("a", F.lit(1)) == F.left("b", F.lit(1))
    return pairwise(_v(s, d), QWEN + DS).groupBy("a", "b").agg(F.first(within).alias("within_model"), F.count(F.lit(1)).alias("questions"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"), F.count_if(F.expr("same")).alias("identical"))


def q_patterns(s, d):
    """How many distinct label sets a question's six votes hold, with the mean and least Jaccard of pairs."""
    sets = _sets(_v(s, d), QWEN + DS).select("question_id", F.size(F.array_distinct(F.array(*QWEN, *DS))).cast("bigint").alias("forms"))
    j = pairwise(_v(s, d), QWEN + DS).groupBy("question_id").agg(F.round(F.avg("jaccard"), 6).alias("mean_jaccard"), F.min("jaccard").alias("least_jaccard"))
    return sets.join(j, "question_id")


def q_unanimity(s, d):
    v = _sets(_v(s, d), QWEN + DS)
    same = lambda n: (F.col(n[0]) == F.col(n[1])) & (F.col(n[1]) == F.col(n[2]))
    return v.agg(F.count(F.lit(1)).alias("questions"), F.count_if(same(QWEN)).alias("qwen_unanimous"), F.count_if(same(DS)).alias("ds_unanimous"), F.count_if(same(QWEN) & same(DS) & (F.col("qwen1") != F.col("ds1"))).alias("both_yet_different"))


def q_change(s, d):
    """Change of the labels from the first to the second vote of each model, by kind."""
    v = _v(s, d)
    one = lambda a, b: adaptive_route(v, a, b).groupBy("relation").agg(F.count(F.lit(1)).alias("n")).withColumn("pair", F.lit(f"{a}-{b}"))
    return one("qwen1", "qwen2").unionByName(one("ds1", "ds2"))


def q_label_change(s, d):
    """Per label: in how many questions it was added and removed from qwen1 to ds1."""
    v = _sets(_v(s, d), ["qwen1", "ds1"])
    e = v.select(F.explode(F.concat(F.transform(F.array_except("ds1", "qwen1"), lambda x: F.struct(x.alias("label_id"), F.lit(1).alias("a"))), F.transform(F.array_except("qwen1", "ds1"), lambda x: F.struct(x.alias("label_id"), F.lit(0).alias("a"))))).alias("e"))
    return e.groupBy("e.label_id").agg(F.count_if(F.expr("e.a = 1")).alias("added"), F.count_if(F.expr("e.a = 0")).alias("removed"))


def q_relationship(s, d):
    return compare_with_legacy(table(s, d, "label_units"), base.legacy(s, d), _majority(s, d))


def q_relationship_summary(s, d):
    return q_relationship(s, d).rollup("unit_type", "relationship").agg(F.count(F.lit(1)).alias("n"))


def q_relationship_by_label(s, d):
    """Per label: kept (old and new), added (new only), dropped (old only) over questions with a majority."""
    new = _majority(s, d)
    old = base.legacy(s, d).join(new.select("question_id").distinct(), "question_id", "left_semi").withColumn("o", F.lit(True))
    j = old.join(new.where("label_id is not null").withColumn("n", F.lit(True)), ["question_id", "label_id"], "full")
    return j.groupBy("label_id").agg(F.count_if(F.expr("o and n")).alias("kept"), F.count_if(F.expr("o is null")).alias("added"), F.count_if(F.expr("n is null")).alias("dropped"))


def q_rollup(s, d):
    return parent_rollup(table(s, d, "parent_plan"), _majority(s, d))


def q_parent_extras(s, d):
    """Labels that a parent has of its own (as a unit) and none of its children's union has."""
    own = consensus_at_least(_v(s, d), QWEN + DS, 2).select(F.col("question_id").alias("parent_id"), "label_id")
    return own.join(table(s, d, "parent_plan").select(F.col("question_id").alias("parent_id")).distinct(), "parent_id", "left_semi").join(q_rollup(s, d), ["parent_id", "label_id"], "left_anti")


def q_perturbation(s, d):
    """Groups of questions by what adding legacy ids to the candidates did: A nothing added, B added but not chosen, C added and chosen."""
    new = _majority(s, d)
    added = base.legacy(s, d).join(_hybrid(s, d), ["question_id", "label_id"], "left_anti").join(new.select("question_id").distinct(), "question_id", "left_semi")
    chosen = added.join(new, ["question_id", "label_id"], "left_semi").groupBy("question_id").agg(F.count(F.lit(1)).alias("chosen"))
    n = added.groupBy("question_id").agg(F.count(F.lit(1)).alias("added"))
    j = new.select("question_id").distinct().join(n, "question_id", "left").join(chosen, "question_id", "left")
    group = F.when(F.col("added").isNull(), "A").when(F.col("chosen").isNull(), "B").otherwise("C")
    return j.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("chosen"), F.lit(0)).alias("chosen"))


_W = f"with {base.VOTES}"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_SUP = lambda names, n="sup": f"{n}v as (select * from votes where vote in {_IN(names)}), {n}n as (select question_id, count(*) n_votes from {n}v group by 1), {n} as (select e.question_id, label_id, count(*) support, any_value(n_votes) n_votes from (select question_id, unnest(labels) label_id from {n}v) e join {n}n x on e.question_id = x.question_id group by all)"
_ALL6 = f"full6 as (select question_id from votes where vote in {_IN(QWEN + DS)} group by 1 having count(distinct vote) = 6)"
_CUBE = f"""{_W}, {base.RANKED}, {_ALL6}, e6 as (select question_id, vote, unnest(labels) label_id from votes where vote in {_IN(QWEN + DS)}),
ch as (select question_id, label_id, count_if(vote in {_IN(QWEN)})::bigint q, count_if(vote in {_IN(DS)})::bigint d from e6 where question_id in (select * from full6) group by all),
hy as (select question_id, label_id, rk from ranked where "method" = 'hybrid' and rk <= 25), ex as (select * from hy union all select distinct question_id, label_id, null::bigint from e6 where (question_id, label_id) not in (select question_id, label_id from hy)),
cube6 as (select r.question_id, r.label_id, rk, coalesce(q, 0) q, coalesce(d, 0) d from ex r left join ch on r.question_id = ch.question_id and r.label_id = ch.label_id where r.question_id in (select * from full6))"""
_PAIR = f"{_W}, {_ALL6}, v6 as (select question_id, vote, labels from votes where vote in {_IN(QWEN + DS)} and question_id in (select * from full6)), pw as (select x.question_id, x.vote a, y.vote b, round(case when len(x.labels) + len(y.labels) = 0 then 1 else len(list_intersect(x.labels, y.labels)) / (len(x.labels) + len(y.labels) - len(list_intersect(x.labels, y.labels))) end, 6) jaccard, x.labels = y.labels same from v6 x join v6 y on x.question_id = y.question_id and x.vote < y.vote)"
_REL = lambda a, b: f"case when len({a}) = 0 and len({b}) = 0 then 'both_empty' when len(list_intersect({a}, {b})) = len({a}) and len({a}) = len({b}) then 'same' when len(list_intersect({a}, {b})) = len({a}) then 'more' when len(list_intersect({a}, {b})) = len({b}) then 'fewer' when len({b}) > len({a}) then 'replaced_more' when len({b}) < len({a}) then 'replaced_fewer' else 'replaced' end"
_TWO = lambda a, b: f"(select x.question_id, x.labels a, y.labels b from votes x join votes y on x.question_id = y.question_id and x.vote = '{a}' and y.vote = '{b}')"
_MAJ = f"{_W}, {_SUP(QWEN)}, {base.LEGACY}, mj as (select q.question_id, label_id from (select distinct question_id from supv) q left join (select * from sup where support >= 2) s on q.question_id = s.question_id)"
_RS = f"""{_MAJ}, os as (select question_id, list(label_id) o from legacy group by 1), ns as (select question_id, coalesce(list(label_id) filter (label_id is not null), []) n from mj group by 1),
rel as (select ns.question_id, unit_type, coalesce(len(o), 0)::bigint n_old, len(n)::bigint n_new, len(list_intersect(coalesce(o, []), n)) k, case when k = n_old and k = n_new then 'exact_match' when k = n_old then 'contains_all_legacy' when k = n_new then 'subset_of_legacy' when k > 0 then 'mixed' else 'disjoint' end relationship from ns join label_units u on u.question_id = ns.question_id left join os on os.question_id = ns.question_id)"""
_ROLL = f"""{_MAJ}, kids as (select distinct parent_id, question_id from (select question_id parent_id, unnest(child_question_ids) question_id from parent_plan where deleted_at is null) where question_id is not null),
st as (select parent_id, count(*) children, count_if(question_id in (select question_id from mj))::bigint done from kids group by 1),
roll as (select k.parent_id, label_id, array_to_string(list_sort(list(distinct k.question_id)), '|') sources, any_value(children) children, any_value(done) done, any_value(done = children) complete from kids k join mj on k.question_id = mj.question_id join st on st.parent_id = k.parent_id where label_id is not null group by all)"""

QUERIES = {
    "latest_success": q_latest, "prefer_success": q_prefer, "attempt_stats": q_attempts, "error_kinds": q_error_kinds, "resume_pending": q_pending, "majority_of_three": q_majority, "strict_intersection": q_strict,
    "consensus_per_model": q_consensus_per_model, "adaptive_route": q_route, "complete_votes": q_complete, "vote_cube": q_cube, "vote_cube_slices": q_cube_slices, "anchor_cooccurrence": q_cooccurrence,
    "pairwise_jaccard": q_pairwise, "pairwise_summary": q_pairwise_summary, "stability_patterns": q_patterns, "vote_unanimity": q_unanimity, "set_change": q_change, "label_change": q_label_change,
    "set_relationship": q_relationship, "set_relationship_summary": q_relationship_summary, "set_relationship_by_label": q_relationship_by_label, "parent_label_rollup": q_rollup, "parent_extras": q_parent_extras, "perturbation_groups": q_perturbation,
}
ORACLES = {
    "latest_success": f"{_W} select question_id, vote, array_to_string(labels, '|') labels, n_choices, seq from votes",
    "prefer_success": "select question_id, vote, arg_max(seq, (coalesce(error, '') = '', seq)) seq, bool_or(coalesce(error, '') = '') success from vote_responses group by all",
    "attempt_stats": "select vote, count(*) n_rows, count_if(coalesce(error, '') <> '')::bigint errors, sum(attempts)::bigint attempts, max(attempts)::bigint most_attempts, round(count_if(coalesce(error, '') <> '') / count(*), 6) error_rate from vote_responses group by all",
    "error_kinds": "select regexp_extract(error, '^([^:]+)', 1) kind, vote, count(*) n from vote_responses where coalesce(error, '') <> '' group by all",
    "resume_pending": f"{_W} select distinct question_id, vote from vote_responses where (question_id, vote) not in (select question_id, vote from votes)",
    "majority_of_three": f"{_W}, {_SUP(QWEN)} select * from sup where support >= 2",
    "strict_intersection": f"{_W}, {_SUP(QWEN + DS)} select *, support = n_votes kept from sup",
    "consensus_per_model": f"{_W}, {_SUP(QWEN)}, {_SUP(DS, 'sd')} select *, 'qwen' model from sup where support >= 2 union all select *, 'ds' from sd where support >= 2",
    "adaptive_route": f"{_W} select question_id, {_REL('a', 'b')} relation, a <> b needs_more from {_TWO('qwen1', 'ds1')}",
    "complete_votes": f"{_W}, {_ALL6} select * from full6",
    "vote_cube": f"{_CUBE} select q, d, count(*) exposures, count(distinct label_id) labels from cube6 group by all",
    "vote_cube_slices": f"{_CUBE}, x as (select c.*, coalesce(unit_type, 'unknown') unit_type, case when rk is null then 'unknown' when rk <= 5 then '1-5' when rk <= 10 then '6-10' else '11-25' end band from cube6 c left join label_units u on u.question_id = c.question_id) select q, d, case when grouping(label_id) = 0 then 'label_id' when grouping(band) = 0 then 'band' when grouping(unit_type) = 0 then 'unit_type' else 'all' end dim, coalesce(unit_type, band, label_id) \"value\", count(*) exposures from x group by grouping sets ((q, d), (q, d, unit_type), (q, d, band), (q, d, label_id))",
    "anchor_cooccurrence": f"{_CUBE}, n as (select a.label_id anchor, o.label_id other, count(*) n from cube6 a join cube6 o on a.question_id = o.question_id and a.label_id <> o.label_id where a.q = 3 and a.d = 3 and o.q + o.d > 0 group by all) select *, row_number() over (partition by anchor order by n desc, other) rk, round(n / sum(n) over (partition by anchor), 6) share from n qualify rk <= 5",
    "pairwise_jaccard": f"{_PAIR} select * from pw",
    "pairwise_summary": f"{_PAIR} select a, b, a[1] = b[1] within_model, count(*) questions, round(avg(jaccard), 6) mean_jaccard, count_if(same)::bigint identical from pw group by all",
    "stability_patterns": f"{_PAIR} select question_id, forms, round(avg(jaccard), 6) mean_jaccard, min(jaccard) least_jaccard from pw join (select question_id, count(distinct labels) forms from v6 group by 1) using (question_id) group by all",
    "vote_unanimity": f"{_PAIR}, u as (select question_id, bool_and(same) filter (a[1] = 'q' and b[1] = 'q') q, bool_and(same) filter (a[1] = 'd' and b[1] = 'd') d, bool_and(same) filter (a = 'ds1' and b = 'qwen1') x from pw group by 1) select count(*) questions, count_if(q)::bigint qwen_unanimous, count_if(d)::bigint ds_unanimous, count_if(q and d and not x)::bigint both_yet_different from u",
    "set_change": f"{_W} select relation, count(*) n, pair from (select {_REL('a', 'b')} relation, 'qwen1-qwen2' pair from {_TWO('qwen1', 'qwen2')} union all select {_REL('a', 'b')}, 'ds1-ds2' from {_TWO('ds1', 'ds2')}) group by all",
    "label_change": f"{_W}, t as (select * from {_TWO('qwen1', 'ds1')}) select label_id, count_if(k)::bigint added, count_if(not k)::bigint removed from (select unnest(list_filter(b, lambda x: not list_contains(a, x))) label_id, true k from t union all select unnest(list_filter(a, lambda x: not list_contains(b, x))), false from t) group by all",
    "set_relationship": f"{_RS} select question_id, unit_type, n_old, n_new, relationship from rel",
    "set_relationship_summary": f"{_RS} select unit_type, relationship, count(*) n from rel group by rollup (unit_type, relationship)",
    "set_relationship_by_label": f"{_MAJ}, o as (select * from legacy where question_id in (select question_id from mj)), n as (select * from mj where label_id is not null) select coalesce(o.label_id, n.label_id) label_id, count_if(o.label_id is not null and n.label_id is not null)::bigint kept, count_if(o.label_id is null)::bigint added, count_if(n.label_id is null)::bigint dropped from o full join n on o.question_id = n.question_id and o.label_id = n.label_id group by 1",
    "parent_label_rollup": f"{_ROLL} select * from roll",
    "parent_extras": f"{_ROLL}, {_SUP(QWEN + DS, 's6')} select question_id parent_id, label_id from s6 where support >= 2 and question_id in (select question_id from parent_plan) and (question_id, label_id) not in (select parent_id, label_id from roll)",
    "perturbation_groups": f"{_MAJ}, {base.RANKED}, ad as (select * from legacy l where question_id in (select question_id from mj) and not exists (select 1 from ranked r where r.\"method\" = 'hybrid' and rk <= 25 and r.question_id = l.question_id and r.label_id = l.label_id)), g as (select q.question_id, count(a.label_id) added, count(m.label_id) chosen from (select distinct question_id from mj) q left join ad a on a.question_id = q.question_id left join mj m on m.question_id = a.question_id and m.label_id = a.label_id group by 1) select case when added = 0 then 'A' when chosen = 0 then 'B' else 'C' end grp, count(*) questions, sum(added)::bigint added, sum(chosen)::bigint chosen from g group by 1",
}
