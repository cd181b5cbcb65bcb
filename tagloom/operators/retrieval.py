"""Candidate retrieval: BM25, exact cosine, rank fusion, comparison of rankings, recall, augmentation.

The label catalogue is small and fixed, so its index is broadcast after its size is checked, and each batch of units is scored against its
postings next to the data; without the check passing, postings are joined by token instead. Rankings break ties by id after scores are rounded,
so they don't depend on the order of sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.plans import base
from tagloom.runtime import spread, table, written

K1, B, TOP = 1.5, 0.75, 20
ROUND = 6
#: The most postings of an index that is sent to the tasks (12 bytes each).
MAX_POSTINGS = 4_000_000
#: The weights of a label's and of a unit's fields.
LABEL_FIELDS = [("label_name", 4), ("label_path", 2), ("definition", 2), ("core_concepts", 2), ("common_assessments", 1), ("distinctions", 2)]
UNIT_FIELDS = [("stem", 2), ("answer_text", 2), ("analysis", 2), ("options", 1), ("parent_stem", 1)]


def token_weights(df: DataFrame, key: str, fields: list[tuple[str, int]]) -> DataFrame:
    """(key, token, w): the tokens of all fields, counted with the field's weight."""
    def weighted(field: str, weight: int):
        value = F.replace(X.text(field), F.lit("->"), F.lit(" ")) if field == "label_path" else field
        return F.transform(X.tokens(value), lambda t: F.struct(t.alias("token"), F.lit(weight).alias("w")))

    cols = [weighted(f, w) for f, w in fields]
    return df.select(key, F.inline(F.concat(*cols))).groupBy(key, "token").agg(F.sum("w").cast("double").alias("w"))


def label_cards(labels: DataFrame) -> DataFrame:
    """The catalogue with short codes B001... in id order and paths with @."""
    code = F.format_string("B%03d", F.row_number().over(Window.orderBy("label_id")))
    return labels.select(code.alias("code"), "label_id", "label_name", X.path_text("label_path").alias("label_path"), "label_type", "definition", "core_concepts", "common_assessments", "distinctions")


def bm25_index(labels: DataFrame) -> DataFrame:
    """(label_id, token, weight): the share of a query token's weight that a label scores."""
    tf = token_weights(labels, "label_id", LABEL_FIELDS)
    size = tf.groupBy("label_id").agg(F.sum("w").alias("len"))
    norms = size.select("label_id", (K1 * (1 - B + B * F.col("len") / F.avg("len").over(Window.partitionBy()))).alias("norm"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return tf.join(df, "token").join(norms, "label_id").select("label_id", "token", (idf * F.col("w") * (K1 + 1) / (F.col("w") + F.col("norm"))).alias("weight"))


class Postings:
    """A label index as arrays: of token t (its place in vocab) the labels and weights from first[t] to first[t + 1]."""

    def __init__(self, tokens: list[str], labels: list[str], weights: np.ndarray):
        self.vocab, token = np.unique(np.array(tokens, object), return_inverse=True) if len(tokens) else (np.empty(0, object), np.empty(0, np.int64))
        self.labels, label = np.unique(np.array(labels, object), return_inverse=True) if len(labels) else (np.empty(0, object), np.empty(0, np.int64))
        order = np.lexsort((label, token))
        self.label, self.weight = label[order].astype(np.int32), np.asarray(weights, np.float64)[order]
        self.first = np.r_[0, np.cumsum(np.bincount(token, minlength=len(self.vocab)))].astype(np.int64)

    def scores(self, rows: np.ndarray, tokens: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """(n, labels) scores of n queries given as (row, token, times); tokens of a row add up in their order."""
        cell, at = np.unique(rows * len(self.vocab) + tokens, return_inverse=True)
        q = np.bincount(at, times, len(cell))
        row, token = cell // len(self.vocab), cell % len(self.vocab)
        many = self.first[token + 1] - self.first[token]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[token], many)
        flat = np.bincount(np.repeat(row * len(self.labels), many) + self.label[place], np.repeat(q, many) * self.weight[place], n * len(self.labels))
        return np.round(flat.reshape(n, len(self.labels)), ROUND)


#: Cells of the table of scores that a task fills at once.
SCORE_CELLS = 200_000


def _search(index: Postings, k: int):
    """Mapper (id, tokens1..n) -> (id, label_id, score, rk)."""
    times = [w for _, w in UNIT_FIELDS]
    step = max(1, SCORE_CELLS // max(1, len(index.labels)))

    def part(b: pa.RecordBatch, vocab: pa.Array, names: pa.Array) -> pa.RecordBatch:
        rows, tokens, weights = [], [], []
        for column, w in zip(b.columns[1:], times):
            found = pc.index_in(column.flatten(), value_set=vocab).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(column).to_numpy(zero_copy_only=False))
            known = ~np.isnan(found) if found.dtype.kind == "f" else np.ones(len(found), bool)
            rows.append(row[known])
            tokens.append(found[known].astype(np.int64))
            weights.append(np.full(known.sum(), float(w)))
        s = index.scores(np.concatenate(rows), np.concatenate(tokens), np.concatenate(weights), b.num_rows)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # labels are in id order
        top = np.take_along_axis(s, order, 1)
        i, r = np.nonzero(top > 0)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), names.take(pa.array(order[i, r])), pa.array(top[i, r]), pa.array(r + 1)], ["question_id", "label_id", "score", "rk"])

    def run(batches):
        vocab, names = pa.array(index.vocab.tolist(), pa.string()), pa.array(index.labels.tolist(), pa.string())
        for b in batches:
            for lo in range(0, b.num_rows, step):
                yield part(b.slice(lo, step), vocab, names)

    return run


def bm25_topk(units: DataFrame, labels: DataFrame, k: int = TOP) -> DataFrame:
    """(question_id, label_id, score, rk): the k best labels of each unit with a score above 0."""
    index = bm25_index(labels)
    rows = index.select("token", "label_id", "weight").limit(MAX_POSTINGS + 1).toPandas()
    if len(rows) > MAX_POSTINGS:
        return bm25_join(units, index, k)
    tokens = spread(units.select("question_id", *[f for f, _ in UNIT_FIELDS])).select("question_id", *[X.tokens(f).alias(f) for f, _ in UNIT_FIELDS])
    return tokens.mapInArrow(_search(Postings(rows["token"].tolist(), rows["label_id"].tolist(), rows["weight"].to_numpy()), k), "question_id string, label_id string, score double, rk long")


def half_even(c):
    """A score rounded as numpy does it, so that ranks don't depend on which way a score was computed."""
    return F.rint(c * 10.0**ROUND) / 10.0**ROUND


def bm25_join(units: DataFrame, index: DataFrame, k: int = TOP) -> DataFrame:
    """The same by an equi-join on tokens, for catalogues of any size."""
    hits = token_weights(units, "question_id", UNIT_FIELDS).join(index, "token")
    score = hits.groupBy("question_id", "label_id").agg(half_even(F.sum(F.col("w") * F.col("weight"))).alias("score")).where("score > 0")
    rk = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "label_id")).cast("bigint")
    return score.withColumn("rk", rk).where(F.col("rk") <= k)


def _nearest(ids: list[int], queries: np.ndarray, k: int):
    """Mapper (id, vector) -> the partition's k nearest rows of every query (query_id, vec_id, similarity)."""
    few = 256  # queries compared at once, which bounds the matrix of similarities

    def run(batches):
        best = {lo: (np.empty((len(ids[lo : lo + few]), 0)), np.empty((len(ids[lo : lo + few]), 0), np.int64)) for lo in range(0, len(ids), few)}
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for lo, (had, who) in best.items():
                s = np.round(queries[lo : lo + few] @ v.T, ROUND)
                s[np.equal.outer(ids[lo : lo + few], keys)] = -np.inf
                s, others = np.hstack([had, s]), np.hstack([who, np.broadcast_to(keys, s.shape)])
                order = np.lexsort((others, -s))[:, :k]
                best[lo] = np.take_along_axis(s, order, 1), np.take_along_axis(others, order, 1)
        for lo, (s, others) in best.items():
            i, j = np.nonzero(np.isfinite(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[lo : lo + few], np.int64)[i]), pa.array(others[i, j]), pa.array(s[i, j])], ["query_id", "vec_id", "similarity"])

    return run


#: Queries of a nearest-neighbour search that are sent to the tasks at once.
QUERY_BLOCK = 4096


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity, rk): the k rows with the largest cosine to each query, exact, itself left out.

    Queries go to the tasks in blocks of QUERY_BLOCK; every task keeps its k best a query before the shuffle. Rows without a key or with a
    null in the vector take no part; a vector of zeros has similarity 0 to all."""
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    vectors, queries = vectors.where(sound), queries.where(sound).dropDuplicates([key])
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    parts = None
    for n in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == n).select(key, vector).orderBy(key).collect()
        q = np.array([r[1] for r in rows], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(q) else q
        part = vectors.select(F.col(key).cast("bigint"), vector).mapInArrow(_nearest([r[0] for r in rows], q, k), "query_id long, vec_id long, similarity double")
        if blocks > 1:  # one block is held at a time: its result is written before the next is collected
            part = written(_first(part, k), "nearest")
        parts = part if parts is None else parts.unionByName(part)
    return _first(parts, k)


def _first(near: DataFrame, k: int) -> DataFrame:
    rk = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")).cast("bigint")
    return near.drop("rk").withColumn("rk", rk).where(F.col("rk") <= k)


def rrf(ranked: DataFrame, k: int, c: int = 60) -> DataFrame:
    """(question_id, label_id, score, hits, rk) by reciprocal rank over all methods of ranked (question_id, method, label_id, rk)."""
    s = ranked.groupBy("question_id", "label_id").agg(F.round(F.sum(1.0 / (c + F.col("rk"))), 8).alias("score"), F.count(F.lit(1)).alias("hits"))
    rk = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "label_id")).cast("bigint")
    return s.withColumn("rk", rk).where(F.col("rk") <= k)


def quota_fuse(sparse: DataFrame, dense: DataFrame, sparse_quota: int, dense_quota: int, cap: int) -> DataFrame:
    """(question_id, label_id, stage, sparse_rk, dense_rk, rk): the first sparse_quota of sparse, then up to dense_quota of dense not among
    them, then the rest by reciprocal rank. sparse and dense: (question_id, label_id, rk). One full join; the stages are windows."""
    both = sparse.withColumnRenamed("rk", "sparse_rk").join(dense.withColumnRenamed("rk", "dense_rk"), ["question_id", "label_id"], "full")
    first = F.coalesce(F.col("sparse_rk") <= sparse_quota, F.lit(False))
    both = both.withColumn("_first", first)
    new = F.row_number().over(Window.partitionBy("question_id", "_first").orderBy(F.asc_nulls_last("dense_rk"), "label_id"))
    stage = F.when(F.col("_first"), 1).when(F.col("dense_rk").isNotNull() & (new <= dense_quota), 2).otherwise(3)
    score = F.round(F.coalesce(1.0 / (60 + F.col("sparse_rk")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("dense_rk")), F.lit(0.0)), 8)
    both = both.withColumn("stage", stage.cast("bigint")).withColumn("_score", score)
    place = F.when(F.col("stage") == 1, F.col("sparse_rk")).when(F.col("stage") == 2, F.col("dense_rk"))
    rk = F.row_number().over(Window.partitionBy("question_id").orderBy("stage", place, F.desc("_score"), "label_id")).cast("bigint")
    return both.withColumn("rk", rk).where(F.col("rk") <= cap).select("question_id", "label_id", "stage", "sparse_rk", "dense_rk", "rk")


def compare_rankings(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per question in both: top1_same, overlap and jaccard of the first k."""
    top = lambda df, n: df.where(F.col("rk") <= k).groupBy("question_id").agg(F.collect_set("label_id").alias(f"s{n}"), F.min_by("label_id", "rk").alias(f"t{n}"))
    j = top(a, 1).join(top(b, 2), "question_id")
    return j.select("question_id", (F.col("t1") == F.col("t2")).alias("top1_same"), F.size(F.array_intersect("s1", "s2")).cast("bigint").alias("overlap"), F.round(X.jaccard("s1", "s2"), 6).alias("jaccard"))


def recall_at(ranked: DataFrame, targets: DataFrame, ks: list[int]) -> DataFrame:
    """(k, questions, any_hit, all_hit, targets, target_hits): recall for all ks in one pass over targets joined with ranks."""
    j = targets.join(ranked.select("question_id", "label_id", "rk"), ["question_id", "label_id"], "left")
    e = j.select("question_id", "rk", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    per = e.groupBy("question_id", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rk") <= F.col("k")).alias("h"))
    return per.groupBy(F.col("k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.expr("h > 0")).alias("any_hit"), F.count_if(F.expr("h = n")).alias("all_hit"), F.sum("n").alias("targets"), F.sum("h").alias("target_hits"))


def augment(ranked: DataFrame, extra: DataFrame) -> DataFrame:
    """(question_id, label_id, rk, source): ranked with the extra labels it lacks appended in id order, of questions in ranked."""
    missing = extra.join(ranked, ["question_id", "label_id"], "left_anti").join(ranked.select("question_id").distinct(), "question_id", "left_semi")
    marked = ranked.join(extra.withColumn("_x", F.lit(True)), ["question_id", "label_id"], "left").select("question_id", "label_id", "rk", F.when(F.col("_x"), "both").otherwise("retrieval").alias("source"))
    rows = marked.unionByName(missing.select("question_id", "label_id", F.lit(None).cast("int").alias("rk"), F.lit("legacy").alias("source")))
    rk = F.row_number().over(Window.partitionBy("question_id").orderBy(F.asc_nulls_last("rk"), "label_id")).cast("bigint")
    return rows.withColumn("rk", rk)


# --- queries ----------------------------------------------------------------------


def _units(s, d):
    return table(s, d, "label_units")


def _rank(s, d, method):
    return base.rankings(s, d).where(F.col("method") == method).select("question_id", "label_id", "rk")


def text_tokens(s: SparkSession, d: str) -> DataFrame:
    return token_weights(_units(s, d), "question_id", UNIT_FIELDS).groupBy("question_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("w").alias("weight"))


def token_df(s, d):
    return token_weights(table(s, d, "label_catalog"), "label_id", LABEL_FIELDS).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("w").alias("weight"))


def q_label_cards(s, d):
    return label_cards(table(s, d, "label_catalog")).select("code", "label_id", "label_name", "label_path", X.path_parent(F.replace("label_path", F.lit("@"), F.lit("->"))).alias("parent"), X.path_module(F.replace("label_path", F.lit("@"), F.lit("->"))).alias("module"))


def q_bm25(s, d):
    return bm25_topk(_units(s, d), table(s, d, "label_catalog"))


def q_bm25_report(s, d):
    """Units without a candidate and the histogram of candidate counts."""
    n = _units(s, d).select("question_id").join(q_bm25(s, d).groupBy("question_id").agg(F.count(F.lit(1)).alias("n")), "question_id", "left")
    return n.groupBy(F.coalesce("n", F.lit(0)).alias("candidates")).agg(F.count(F.lit(1)).alias("units"))


def q_cosine(s, d):
    v = table(s, d, "embeddings")
    return cosine_topk(v, v.where("vec_id % 20 = 0"))


def q_rrf(s, d):
    return rrf(base.rankings(s, d), 25)


def q_quota(s, d):
    """The original's quotas and cap."""
    return quota_fuse(_rank(s, d, "bm25-char"), _rank(s, d, "dense"), 18, 7, 25)


def q_compare(s, d):
    return compare_rankings(_rank(s, d, "bm25-char"), _rank(s, d, "dense"), TOP)


def q_compare_summary(s, d):
    return q_compare(s, d).agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.expr("top1_same")).alias("top1_same"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


def q_recall(s, d):
    return recall_at(_rank(s, d, "hybrid"), base.legacy(s, d).join(_rank(s, d, "hybrid").select("question_id").distinct(), "question_id", "left_semi"), [1, 3, 5, 10, 25])


def q_recall_by_type(s, d):
    t = base.legacy(s, d).join(_units(s, d).select("question_id", "unit_type"), "question_id")
    j = t.join(_rank(s, d, "hybrid"), ["question_id", "label_id"], "left")
    return j.groupBy("unit_type").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.expr("rk <= 5")).alias("hits_5"), F.count_if(F.expr("rk is not null")).alias("hits"), F.round(F.try_divide(F.count_if(F.expr("rk <= 5")), F.count(F.lit(1))), 6).alias("recall_5"))


def q_recall_by_label(s, d):
    j = base.legacy(s, d).join(_rank(s, d, "hybrid"), ["question_id", "label_id"], "left")
    return j.groupBy("label_id").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.expr("rk <= 5")).alias("hits_5"))


def q_misses(s, d):
    r = _rank(s, d, "hybrid")
    return base.legacy(s, d).join(r.select("question_id").distinct(), "question_id", "left_semi").join(r, ["question_id", "label_id"], "left_anti")


def q_augment(s, d):
    return augment(_rank(s, d, "hybrid"), base.legacy(s, d))


def q_source_mix(s, d):
    return _source_mix(q_quota(s, d))


def _source_mix(fused):
    """How many fused candidates came from sparse only, dense only and both, by stage."""
    mix = F.when(F.col("sparse_rk").isNull(), "dense").when(F.col("dense_rk").isNull(), "sparse").otherwise("both")
    return fused.groupBy("stage", mix.alias("mix")).agg(F.count(F.lit(1)).alias("n"))


def q_target_rank(s, d):
    """Whether a question's first legacy label is among its candidates, with its rank and the list's size."""
    r = _rank(s, d, "hybrid")
    size = r.groupBy("question_id").agg(F.count(F.lit(1)).alias("listed"))
    first = base.legacy(s, d).groupBy("question_id").agg(F.min("label_id").alias("label_id"))
    return first.join(size, "question_id").join(r, ["question_id", "label_id"], "left").select("question_id", "label_id", F.col("rk").isNotNull().alias("hit"), F.col("rk").cast("bigint").alias("rk"), "listed", X.rank_band("rk").alias("band"))


def _sql_tokens(e: str) -> str:
    run = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
    return f"""list_concat(regexp_extract_all(lower(coalesce({e}, '')), '[a-z0-9]+(?:[-_.][a-z0-9]+)*'), flatten(list_transform(regexp_extract_all(lower(coalesce({e}, '')), '{run}'), lambda r: case when length(r) = 1 then [r]
  else list_concat([substr(r, i, 2) for i in range(1, length(r))], case when length(r) >= 3 then [substr(r, i, 3) for i in range(1, length(r) - 1)] else [] end, case when length(r) <= 12 then [r] else [] end) end)))"""


def _sql_weights(name: str, src: str, key: str, fields) -> str:
    value = lambda f: f"replace({f}, '->', ' ')" if f == "label_path" else f
    parts = " union all ".join(f"select {key}, unnest({_sql_tokens(value(f))}) token, {w} w from {src}" for f, w in fields)
    return f"{name} as (select {key}, token, sum(w)::double w from ({parts}) group by all)"


_LT = _sql_weights("lt", "label_catalog", "label_id", LABEL_FIELDS)
_UT = _sql_weights("ut", "label_units", "question_id", UNIT_FIELDS)
_BM25 = f"""with {_LT}, {_UT},
ln as (select label_id, {K1} * (1 - {B} + {B} * sum(w) / avg(sum(w)) over ()) norm, count(*) over () n from lt group by label_id),
tdf as (select token, count(*) df from lt group by token),
ix as (select label_id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * w * {K1 + 1} / (w + norm) weight from lt join tdf using (token) join ln using (label_id)),
sc as (select question_id, label_id, round(sum(w * weight), {ROUND}) score from ut join ix using (token) group by all),
bm as (select question_id, label_id, score, row_number() over (partition by question_id order by score desc, label_id) rk from sc where score > 0 qualify rk <= {TOP})"""
_R = lambda m: f"(select question_id, label_id, rk from ranked where \"method\" = '{m}')"
_QUOTA = f"""with {base.RANKED},
b as (select coalesce(s.question_id, e.question_id) question_id, coalesce(s.label_id, e.label_id) label_id, s.rk sparse_rk, e.rk dense_rk, coalesce(s.rk <= 18, false) f
  from {_R('bm25-char')} s full join {_R('dense')} e on s.question_id = e.question_id and s.label_id = e.label_id),
n as (select *, row_number() over (partition by question_id, f order by dense_rk nulls last, label_id) new, round(coalesce(1.0 / (60 + sparse_rk), 0) + coalesce(1.0 / (60 + dense_rk), 0), 8) sc from b),
g as (select *, case when f then 1 when dense_rk is not null and new <= 7 then 2 else 3 end::bigint stage from n),
q as (select question_id, label_id, stage, sparse_rk::int sparse_rk, dense_rk::int dense_rk, row_number() over (partition by question_id order by stage, case stage when 1 then sparse_rk when 2 then dense_rk end nulls first, sc desc, label_id) rk from g qualify rk <= 25)"""
_CMP = f"""with {base.RANKED},
a as (select question_id, list(label_id) s, arg_min(label_id, rk) t from {_R('bm25-char')} where rk <= {TOP} group by 1), e as (select question_id, list(label_id) s, arg_min(label_id, rk) t from {_R('dense')} where rk <= {TOP} group by 1),
cmp as (select question_id, a.t = e.t top1_same, len(list_intersect(a.s, e.s))::bigint overlap, round(len(list_intersect(a.s, e.s)) / (len(a.s) + len(e.s) - len(list_intersect(a.s, e.s))), 6) jaccard from a join e using (question_id))"""
_LEG = f"with {base.LEGACY}, {base.RANKED}, hy as {_R('hybrid')}"

QUERIES = {
    "text_tokens": text_tokens, "token_df": token_df, "label_cards": q_label_cards, "bm25_topk": q_bm25, "bm25_candidate_counts": q_bm25_report, "cosine_topk": q_cosine,
    "rrf_fuse": q_rrf, "quota_fuse": q_quota, "fusion_source_mix": q_source_mix, "compare_rankings": q_compare, "compare_rankings_summary": q_compare_summary,
    "recall_at_k": q_recall, "recall_by_type": q_recall_by_type, "recall_by_label": q_recall_by_label, "recall_misses": q_misses, "augment_candidates": q_augment, "target_in_candidates": q_target_rank,
}
ORACLES = {
    "text_tokens": f"with {_UT} select question_id, count(*) tokens, sum(w) weight from ut group by all",
    "token_df": f"with {_LT} select token, count(*) df, sum(w) weight from lt group by all",
    "label_cards": "select 'B' || lpad((row_number() over (order by label_id))::varchar, 3, '0') code, label_id, label_name, replace(label_path, '->', '@') label_path, case when label_path like '%->%' then array_to_string(list_slice(string_split(label_path, '->'), 1, -2), '->') else '' end parent, coalesce(string_split(label_path, '->')[2], 'missing') module from label_catalog",
    "bm25_topk": f"{_BM25} select * from bm",
    "bm25_candidate_counts": f"{_BM25}, n as (select question_id, count(*) n from bm group by all) select coalesce(n, 0) candidates, count(*) units from label_units left join n using (question_id) group by all",
    "cosine_topk": f"select q.vec_id query_id, v.vec_id vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), {ROUND}) similarity, row_number() over (partition by q.vec_id order by similarity desc, v.vec_id) rk from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id qualify rk <= 10",
    "rrf_fuse": f"with {base.RANKED}, s as (select question_id, label_id, round(sum(1.0 / (60 + rk)), 8) score, count(*) hits from ranked group by all), w as (select *, row_number() over (partition by question_id order by score desc, label_id) rk from s) select * from w where rk <= 25",
    "quota_fuse": f"{_QUOTA} select * from q",
    "fusion_source_mix": f"{_QUOTA} select stage, case when sparse_rk is null then 'dense' when dense_rk is null then 'sparse' else 'both' end mix, count(*) n from q group by all",
    "compare_rankings": f"{_CMP} select * from cmp",
    "compare_rankings_summary": f"{_CMP} select count(*) questions, count_if(top1_same)::bigint top1_same, round(avg(overlap), 6) mean_overlap, round(avg(jaccard), 6) mean_jaccard from cmp",
    "recall_at_k": f"{_LEG}, t as (select l.question_id, k, count(*) n, count_if(rk <= k) h from legacy l left join hy on l.question_id = hy.question_id and l.label_id = hy.label_id, (select unnest([1, 3, 5, 10, 25])::bigint k) where l.question_id in (select question_id from hy) group by all) select k, count(*) questions, count_if(h > 0)::bigint any_hit, count_if(h = n)::bigint all_hit, sum(n)::bigint targets, sum(h)::bigint target_hits from t group by all",
    "recall_by_type": f"{_LEG} select unit_type, count(*) targets, count_if(rk <= 5)::bigint hits_5, count(rk) hits, round(count_if(rk <= 5) / count(*), 6) recall_5 from legacy l join label_units u on l.question_id = u.question_id left join hy on l.question_id = hy.question_id and l.label_id = hy.label_id group by all",
    "recall_by_label": f"{_LEG} select l.label_id, count(*) targets, coalesce(count_if(rk <= 5), 0)::bigint hits_5 from legacy l left join hy on l.question_id = hy.question_id and l.label_id = hy.label_id group by all",
    "recall_misses": f"{_LEG} select question_id, label_id from legacy l where question_id in (select question_id from hy) and not exists (select 1 from hy where hy.question_id = l.question_id and hy.label_id = l.label_id)",
    "augment_candidates": f"{_LEG}, x as (select hy.question_id, hy.label_id, rk, case when l.label_id is null then 'retrieval' else 'both' end source from hy left join legacy l on l.question_id = hy.question_id and l.label_id = hy.label_id union all select question_id, label_id, null, 'legacy' from legacy l where question_id in (select question_id from hy) and not exists (select 1 from hy where hy.question_id = l.question_id and hy.label_id = l.label_id)) select question_id, label_id, row_number() over (partition by question_id order by rk nulls last, label_id) rk, source from x",
    "target_in_candidates": f"{_LEG}, f as (select question_id, min(label_id) label_id from legacy group by 1), z as (select question_id, count(*) listed from hy group by 1) select f.question_id, f.label_id, rk is not null hit, rk::bigint rk, listed, case when rk is null then 'unknown' when rk <= 5 then '1-5' when rk <= 10 then '6-10' when rk <= 25 then '11-25' else '26+' end band from f join z using (question_id) left join hy on f.question_id = hy.question_id and f.label_id = hy.label_id",
}
