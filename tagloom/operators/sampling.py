"""Deterministic sampling: by hash, so the same rows come out on any layout of the data and any number of executors.

A rank is the sha256 of a seed and the key as a hexadecimal string (functions.text.hash_rank). Reservoirs with a seeded generator depend on
the order of rows and are replaced by the bottom-k of the hash: as uniform, but reproducible.

bottom_k prunes within each task before the shuffle (Spark's window group limit), so a group may be of any size. Windows over all rows
(round_robin, quantile) are split by group; a single global group is ranked by a global sort."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.plans import base
from tagloom.runtime import table, written

SEED = "tagloom-1"
TASKS = 32  # each of which sends its own best rows to the driver, at most


def bernoulli(df: DataFrame, key: str, share: float, seed: str = SEED) -> DataFrame:
    """Rows whose hash lies in the first `share` of its range; a share of 1 keeps all."""
    if share >= 1:
        return df
    edge = f"{int(share * 2**64):016x}"
    return df.where(F.left(X.hash_rank(seed, key), F.lit(16)) < edge)


def bottom_k(df: DataFrame, group: list[str], key: str, k: int, seed: str = SEED) -> DataFrame:
    """The k rows of each group with the smallest hashes."""
    w = Window.partitionBy(*group).orderBy("_h", key)
    return df.withColumn("_h", X.hash_rank(seed, key)).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).drop("_h")


def round_robin(df: DataFrame, group: str, source: str, key: str, k: int, seed: str = SEED) -> DataFrame:
    """k rows of each group, taken in turns from its sources: first each source's first row by hash, then each one's second ..."""
    own = bottom_k(df, [group, source], key, k, seed).withColumnRenamed("pick", "turn")
    w = Window.partitionBy(group).orderBy("turn", source, key)
    return own.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def quantile_sample(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k rows of each group at even places of its order (first and last among them); all rows of a group of at most k."""
    w = Window.partitionBy(group)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    # The place of pick p is the half-even rounding of p * (n - 1) / (k - 1); a row is a pick if one of the two nearest p lands on it.
    step = (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))
    near = F.round(F.col("_i") / F.greatest(step, F.lit(1e-9)))
    hit = F.lit(False)
    for off in (-1, 0, 1):
        p = near + off
        hit = hit | ((p >= 0) & (p <= k - 1) & (F.expr("0") + F.rint(p * step) == F.col("_i")))
    return r.where((F.col("_n") <= k) | hit).drop("_i", "_n")


def quota_fill(df: DataFrame, group: str, bucket: str, key: str, quotas: dict[str, int], total: int, seed: str = SEED) -> DataFrame:
    """`total` rows of each group: of each bucket up to its quota, then filled from what is left, all by hash. `stage` is quota or fill."""
    quota = F.lit(0)
    for b, n in quotas.items():
        quota = F.when(F.col(bucket) == b, n).otherwise(quota)
    own = bottom_k(df, [group, bucket], key, total, seed).withColumn("stage", F.when(F.col("pick") <= quota, "quota").otherwise("fill"))
    w = Window.partitionBy(group).orderBy(F.desc("stage"), X.hash_rank(seed, key), key)
    return own.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= total)


def proportional(sizes: DataFrame, by: str, count: str, total: int) -> DataFrame:
    """(by, count, share): total split over strata by largest deficit, at least 1 for each that isn't empty. sizes has one row a stratum."""
    n = F.sum(count).over(Window.partitionBy())
    exact = F.col(count) * F.lit(total) / n
    lower = F.greatest(F.lit(1), F.floor(exact)).cast("bigint")
    r = sizes.where(F.col(count) > 0).withColumn("_e", exact).withColumn("_f", lower)
    rest = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), by))
    return r.select(by, count, (F.col("_f") + F.when(place <= rest, 1).otherwise(0)).alias("share"))


def char_batches(df: DataFrame, group: str, order: str, size: str, most_rows: int, most_chars: int) -> DataFrame:
    """(group, order, size, batch): rows of each group in order, a new batch begun when rows or characters would go over.

    A running sum with resets is sequential within a group: it is carried along partitions sorted by group and order, so no group is held in
    memory, however large. A null size counts as 0; the largest group's rows pass through one task."""
    names = [c for c in df.columns if c in (group, order, size)]

    def run(frames):
        now, batch, rows, chars = object(), 0, 0, 0
        for f in frames:
            out = []
            for g, n in zip(f[group], f[size].fillna(0)):
                if g != now:
                    now, batch, rows, chars = g, 0, 0, 0
                elif rows >= most_rows or chars + n > most_chars:
                    batch, rows, chars = batch + 1, 0, 0
                rows, chars = rows + 1, chars + n
                out.append(batch)
            yield f.assign(batch=pd.Series(out, f.index, "int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names) + ", batch long"
    return df.select(*names).where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)


def _few(df: DataFrame, parts: list[str], k: int) -> DataFrame:
    """The first k rows of each part by hash; cut to k before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy("_h", "_key"))).where(F.col("_n") <= k).drop("_n")


def pilot(df: DataFrame, key: str, kind: str, stratum: str, must: str, per_stratum: int, shares: dict[str, float], total: int, seed: str = SEED) -> DataFrame:
    """(key, reason): mandatory rows, then per_stratum rows of each stratum, then rows of each kind up to its share, then any, up to total.

    Each row gets the earliest stage that takes it; the stages are windows over hash order. Only rows that can be taken get there: of each
    stratum the first per_stratum, and of each kind the first 2 * total (of which the strata have less than total, or nothing is left to fill)."""
    r = df.select(F.col(key).alias("_key"), F.col(kind).alias("_kind"), F.col(stratum).alias("_stratum"), F.coalesce(F.expr(must), F.lit(False)).alias("_m")).withColumn("_h", X.hash_rank(seed, "_key"))
    r = _few(r, ["_stratum", "_m"], per_stratum).unionByName(_few(r, ["_kind", "_m"], 2 * total)).distinct()
    key, kind, stratum, name_of = "_key", "_kind", "_stratum", key
    r = r.withColumn("_s", F.row_number().over(Window.partitionBy(stratum, "_m").orderBy("_h", key)))
    r = r.withColumn("_stage", F.when(F.col("_m"), 1).when(F.col("_s") <= per_stratum, 2).otherwise(3))
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy("_stage", "_h", key)))
    room = F.lit(0)
    for name, share in shares.items():
        room = F.when(F.col(kind) == name, math.floor(total * share)).otherwise(room)
    r = r.withColumn("_stage", F.when(F.col("_stage") < 3, F.col("_stage")).when(F.col("_k") <= room, 3).otherwise(4))
    # The first `total` rows by (stage, hash) come from a top-k, not from one task's window over all rows.
    top = r.orderBy("_stage", "_h", key).limit(total)
    return top.select(F.col(key).alias(name_of), F.element_at(F.array(*map(F.lit, ["mandatory", "stratum", "kind", "fill"])), F.col("_stage")).alias("reason"))


def greedy_rare(pool: DataFrame, key: str, tags: str, k: int, bound: int = 20_000, seed: str = SEED) -> list[str]:
    """k keys picked one after the other, each time the row whose tags were picked least often so far weigh most. key should be unique.

    Tags are counted over all rows. Each pick changes later weights, but only downwards: the driver holds the `bound` rows that weigh most, and
    picks from them as long as the best comes before the last of them, which all other rows came behind. Then all rows are weighed anew."""
    e = pool.select(key, X.hash_rank(seed, key).alias("_h"), F.explode_outer(tags).alias("_t"))
    e = e.join(e.where("_t is not null").groupBy("_t").agg(F.count(F.lit(1)).alias("_n")), "_t", "left")
    # Sorted by tag, so that sums here and on the driver add in one order.
    rows = written(e.groupBy(key, "_h").agg(F.array_sort(F.collect_set(F.when(F.col("_t").isNotNull(), F.struct("_t", "_n")))).alias("_c")), "greedy")
    seen: dict[str, int] = {}
    out: list[str] = []

    def weight(c) -> float:
        total = 0.0
        for t, n in c:
            total += 1 / n / (1 + seen.get(t, 0))
        return total

    while len(out) < k:
        times = F.from_json(F.lit(json.dumps(seen)), "map<string,bigint>")
        w = F.aggregate("_c", F.lit(0.0), lambda x, s: x + F.lit(1.0) / s["_n"] / (1 + F.coalesce(F.try_element_at(times, s["_t"].cast("string")), F.lit(0))))
        left = rows.where(~F.col(key).isin(out)) if out else rows
        held = [(r[0], r["_h"], r["_c"]) for r in left.select(key, "_h", "_c").coalesce(TASKS).orderBy(F.desc(w), "_h", key).limit(bound).collect()]
        last = (-weight(held[-1][2]), held[-1][1], held[-1][0]) if len(held) == bound else None
        while held and len(out) < k:
            place, n = min(((-weight(c), h, x), n) for n, (x, h, c) in enumerate(held))
            if last is not None and place > last:
                break
            out.append(place[2])
            for t, _ in held.pop(n)[2]:
                seen[t] = seen.get(t, 0) + 1
        if last is None:
            break
    return out


# --- queries ----------------------------------------------------------------------


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("doc_kind", F.lit("none")).alias("doc_kind"), "n_chars")


def _scores(s, d):
    p = base.scored(s, d).groupBy("question_id", "label_id").agg(F.max("score").alias("score"))
    return p.withColumn("band", X.score_band("score")).withColumn("pair_id", F.concat("question_id", F.lit("::"), "label_id"))


def q_bernoulli(s: SparkSession, d: str) -> DataFrame:
    return bernoulli(_docs(s, d), "doc_id", 0.05).select("doc_id")


def q_bottom_k(s, d):
    return bottom_k(_docs(s, d), ["lang", "doc_kind"], "doc_id", 5).select("lang", "doc_kind", "doc_id", F.col("pick").cast("bigint").alias("pick"))


def q_round_robin(s, d):
    return round_robin(_docs(s, d), "doc_kind", "source", "doc_id", 20).select("doc_kind", "source", "doc_id", F.col("pick").cast("bigint").alias("pick"))


def q_quantile(s, d):
    return quantile_sample(_scores(s, d), "label_id", ["score", "pair_id"], 5).select("label_id", "pair_id", "score")


def q_quota(s, d):
    return quota_fill(_scores(s, d), "label_id", "band", "pair_id", {"high_match": 3, "borderline_match": 3, "gray": 2}, 10).select("label_id", "pair_id", "band", "stage", F.col("pick").cast("bigint").alias("pick"))


def q_proportional(s, d):
    n = _docs(s, d).groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"))
    return proportional(n, "doc_kind", "n", 100)


def q_batches(s, d):
    """Scoring requests: pairs of each label in batches of at most 20 questions and 6,000 characters."""
    u = table(s, d, "label_units").select("question_id", (F.length(X.text("stem")) + F.length(X.text("options"))).cast("bigint").alias("chars"))
    return char_batches(base.legacy(s, d).join(u, "question_id"), "label_id", "question_id", "chars", 20, 6000)


def q_pilot(s, d):
    u = table(s, d, "label_units").select("question_id", "unit_type", F.coalesce(F.element_at("metadata", "difficulty"), F.lit("none")).alias("difficulty"), "flags")
    return pilot(u, "question_id", "unit_type", "difficulty", "flags.parent_context_missing or flags.image_context_missing", 20, {"sub_question": 0.55, "standalone": 0.40, "orphan_sub_question": 0.05}, 400)


def q_boundary(s, d):
    """Boundary sample: of each label its two best and two worst matches and its two nearest misses."""
    p = _scores(s, d).withColumn("hit", F.col("score") >= base.MATCH)
    w = Window.partitionBy("label_id", "hit")
    r = p.withColumn("hi", F.row_number().over(w.orderBy(F.desc("score"), "pair_id"))).withColumn("lo", F.row_number().over(w.orderBy("score", "pair_id")))
    kind = F.when(F.col("hit") & (F.col("hi") <= 2), "best").when(F.col("hit") & (F.col("lo") <= 2), "worst").when(~F.col("hit") & (F.col("hi") <= 2), "near_miss")
    return r.withColumn("kind", kind).where("kind is not null").select("label_id", "pair_id", "kind", "score")


def q_examples(s, d):
    """For each label the best, the worst and the median example by score."""
    g = _scores(s, d).groupBy("label_id").agg(F.max_by("pair_id", F.struct("score", "pair_id")).alias("best"), F.min_by("pair_id", F.struct("score", "pair_id")).alias("worst"), F.expr("percentile_disc(0.5) within group (order by score)").alias("median_score"), F.count(F.lit(1)).alias("n"))
    return g


def q_priority(s, d):
    """Review pool by priority: uncertain scores of labels with few pairs first; the top 100 are recommended."""
    p = _scores(s, d)
    n = p.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    j = p.join(n, "label_id").withColumn("priority", F.round(1 - F.abs(F.col("score") - base.MATCH) + F.when(F.col("n") < 30, 0.5).otherwise(0.0), 6))
    return j.orderBy(F.desc("priority"), "pair_id").limit(100).select("pair_id", "priority", F.when(F.col("priority") >= 1, "P1").when(F.col("priority") >= 0.9, "P2").otherwise("P3").alias("tier"))


def q_groups_hit(s, d):
    """Complete compound questions with most labels hit: living parents whose children are all there, their children numbered."""
    kids = table(s, d, "parent_plan").where("deleted_at is null").select(F.col("question_id").alias("parent_id"), F.explode("child_question_ids").alias("question_id")).where("question_id is not null").distinct()
    there = table(s, d, "label_units").select("question_id", F.lit(1).alias("there"))
    hits = base.legacy(s, d).groupBy("question_id").agg(F.count(F.lit(1)).alias("hits"))
    j = kids.join(there, "question_id", "left").join(hits, "question_id", "left")
    full = j.groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"), F.count("there").alias("present"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).where("children = present")
    top = full.orderBy(F.desc("hits"), "parent_id").limit(50)
    return kids.join(top, "parent_id").withColumn("child_no", F.row_number().over(Window.partitionBy("parent_id").orderBy("question_id")).cast("bigint")).select("parent_id", "question_id", "child_no", "children", "hits")


def q_first_n(s, d):
    """The first three arrivals of each method and question, by time."""
    c = table(s, d, "candidates").select("question_id", "method", "retrieval_version", "ingested_at").distinct()
    w = Window.partitionBy("question_id", "method").orderBy("ingested_at", "retrieval_version")
    return c.withColumn("pick", F.row_number().over(w).cast("bigint")).where("pick <= 3")


def q_shards(s, d):
    """Fixed-size shards of the units in id order, with first and last id: positions by a global sort and per-partition counts."""
    u = table(s, d, "label_units").select("question_id")
    size = 1000
    r = u.repartitionByRange("question_id").sortWithinPartitions("question_id").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    # Written, since counts and positions must see the same partitions.
    local = written(r.select("question_id", "_p", (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("_i")), "shards")
    before = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pos = local.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("shard", F.floor((F.col("_b") + F.col("_i")) / size))
    return pos.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("question_id").alias("first_id"), F.max("question_id").alias("last_id"))


_H = lambda k: f"sha256('{SEED}' || chr(0) || {k}::varchar)"
_D = "docs as (select doc_id, coalesce(lang, 'none') lang, coalesce(source, 'none') source, coalesce(doc_kind, 'none') doc_kind from documents)"
_S = f"with {base.SCORED}, p0 as (select question_id, label_id, max(score) score from scored group by all), p as (select *, case when score = 0 then 'zero' when score < 0.4 then 'weak_related' when score < 0.7 then 'gray' when score < 0.8 then 'borderline_match' else 'high_match' end band, question_id || '::' || label_id pair_id from p0)"

QUERIES = {
    "hash_bernoulli": q_bernoulli, "bottom_k_per_group": q_bottom_k, "round_robin_sample": q_round_robin, "quantile_sample": q_quantile, "quota_fill_sample": q_quota, "proportional_allocation": q_proportional, "char_budget_batches": q_batches,
    "pilot_sample": q_pilot, "boundary_sample": q_boundary, "example_picker": q_examples, "review_priority": q_priority, "compound_groups": q_groups_hit, "first_n_per_group": q_first_n, "fixed_shards": q_shards,
}
ORACLES = {
    "hash_bernoulli": f"select doc_id from documents where left({_H('doc_id')}, 16) < '{int(0.05 * 2**64):016x}'",
    "bottom_k_per_group": f"with {_D} select lang, doc_kind, doc_id, row_number() over (partition by lang, doc_kind order by {_H('doc_id')}, doc_id) pick from docs qualify pick <= 5",
    "round_robin_sample": f"with {_D}, t as (select *, row_number() over (partition by doc_kind, source order by {_H('doc_id')}, doc_id) turn from docs) select doc_kind, source, doc_id, row_number() over (partition by doc_kind order by turn, source, doc_id) pick from t qualify pick <= 20",
    "quantile_sample": f"{_S}, r as (select *, row_number() over (partition by label_id order by score, pair_id) - 1 i, count(*) over (partition by label_id) n from p) select label_id, pair_id, score from r where n <= 5 or i in (select round_even(k * (n - 1) / 4.0, 0) from (select unnest(range(5)) k))",
    "quota_fill_sample": f"{_S}, r as (select *, row_number() over (partition by label_id, band order by {_H('pair_id')}, pair_id) i from p), s as (select *, case when i <= case band when 'high_match' then 3 when 'borderline_match' then 3 when 'gray' then 2 else 0 end then 'quota' else 'fill' end stage from r where i <= 10) select label_id, pair_id, band, stage, row_number() over (partition by label_id order by stage desc, {_H('pair_id')}, pair_id) pick from s qualify pick <= 10",
    "proportional_allocation": f"with {_D}, n as (select doc_kind, count(*) n from docs group by 1), e as (select *, n * 100 / sum(n) over () e, greatest(1, floor(n * 100 / sum(n) over ()))::bigint f from n), r as (select *, 100 - sum(f) over () rest, row_number() over (order by round(e - f, 9) desc, doc_kind) place from e) select doc_kind, n, f + (place <= rest)::int \"share\" from r",
    "boundary_sample": f"{_S}, r as (select *, score >= {base.MATCH} hit, row_number() over (partition by label_id, score >= {base.MATCH} order by score desc, pair_id) hi, row_number() over (partition by label_id, score >= {base.MATCH} order by score, pair_id) lo from p), k as (select label_id, pair_id, case when hit and hi <= 2 then 'best' when hit and lo <= 2 then 'worst' when not hit and hi <= 2 then 'near_miss' end kind, score from r) select * from k where kind is not null",
    "example_picker": f"{_S} select label_id, arg_max(pair_id, (score, pair_id)) best, arg_min(pair_id, (score, pair_id)) worst, quantile_disc(score, 0.5) median_score, count(*) n from p group by 1",
    "review_priority": f"{_S}, j as (select *, round(1 - abs(score - {base.MATCH}) + case when count(*) over (partition by label_id) < 30 then 0.5 else 0 end, 6) priority from p) select pair_id, priority, case when priority >= 1 then 'P1' when priority >= 0.9 then 'P2' else 'P3' end tier from j order by priority desc, pair_id limit 100",
    "compound_groups": f"with {base.LEGACY}, kids as (select distinct parent_id, question_id from (select question_id parent_id, unnest(child_question_ids) question_id from parent_plan where deleted_at is null) where question_id is not null), h as (select question_id, count(*) hits from legacy group by 1), f as (select k.parent_id, count(*) children, coalesce(sum(hits), 0)::bigint hits from kids k left join h on h.question_id = k.question_id left join label_units u on u.question_id = k.question_id group by 1 having count(*) = count(u.question_id) order by 3 desc, 1 limit 50) select k.parent_id, k.question_id, row_number() over (partition by k.parent_id order by k.question_id) child_no, children, hits from kids k join f on f.parent_id = k.parent_id",
    "first_n_per_group": "select *, row_number() over (partition by question_id, \"method\" order by ingested_at, retrieval_version) pick from (select distinct question_id, \"method\", retrieval_version, ingested_at from candidates) qualify pick <= 3",
    "fixed_shards": "select (row_number() over (order by question_id) - 1) // 1000 shard, question_id from label_units",
    "pilot_sample": f"with u as (select question_id, unit_type, coalesce(metadata['difficulty'], 'none') difficulty, coalesce(flags.parent_context_missing or flags.image_context_missing, false) m, {_H('question_id')} h from label_units), a as (select *, case when m then 1 when row_number() over (partition by difficulty, m order by h, question_id) <= 20 then 2 else 3 end st from u), b as (select *, case when st < 3 then st when row_number() over (partition by unit_type order by st, h, question_id) <= case unit_type when 'sub_question' then 220 when 'standalone' then 160 when 'orphan_sub_question' then 20 else 0 end then 3 else 4 end st2 from a) select question_id, ['mandatory', 'stratum', 'kind', 'fill'][st2] reason from b order by st2, h, question_id limit 400",
}
ORACLES["char_budget_batches"] = f"""with recursive {base.LEGACY}, u as (select question_id, length(coalesce(stem, '')) + length(coalesce(options, '')) chars from label_units),
n as (select label_id, question_id, chars, row_number() over (partition by label_id order by question_id) i from legacy join u using (question_id)),
r as (select label_id, i, 0 batch, 1 k, chars total from n where i = 1
  union all select n.label_id, n.i, case when k >= 20 or total + chars > 6000 then batch + 1 else batch end, case when k >= 20 or total + chars > 6000 then 1 else k + 1 end, case when k >= 20 or total + chars > 6000 then chars else total + chars end from r join n on n.label_id = r.label_id and n.i = r.i + 1)
select label_id, question_id, chars, batch::bigint batch from r join n using (label_id, i)"""
ORACLES["fixed_shards"] = "with r as (" + ORACLES["fixed_shards"] + ") select shard, count(*) n, min(question_id) first_id, max(question_id) last_id from r group by 1"
