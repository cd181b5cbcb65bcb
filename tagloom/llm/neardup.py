"""Near-duplicate records: every pair of texts whose character-gram Jaccard similarity reaches a threshold.

Signature-coordinate inverted join. A text's signature has COORDS coordinates, each the mix of ROWS min-hashes of its distinct grams, so two texts
of similarity s agree in a coordinate with probability s^ROWS. Documents are posted under (coordinate, value) pairs, the lists are joined, collisions are
counted, and pairs that agree in at least MATCH coordinates are verified exactly on their gram sets.

Prefix: coordinates are put into one order for all texts, rare values first. Two texts with MATCH common values have SEEN of them among the first
COORDS - MATCH + SEEN of either in that order, so only those are posted and only pairs with SEEN collisions go on. Skip: the other
MATCH - SEEN values, the most frequent ones of each text, are never posted; they are looked up in the signatures of the pairs that go on.
Frequencies come from all texts (values seen at least LOCAL times in one block of a task, summed up; the FREQUENT largest are kept). They
set the order and the salts only: any order gives the same result.

Skew: equal texts are one class, and only classes are posted, so a group of copies costs one row. Values with long lists are joined in salted
parts, and so is the expansion of a hot class into its ids, on both of its sides.

A class is known by two 64-bit hashes of its text; texts with the same first hash are verified apart.

Recall at similarity s is P(Binomial(COORDS, s^ROWS) >= MATCH): 0.999 at 0.70, 0.9999 at 0.75, 1.000 from 0.80 on.

Groups: connected components of the pairs, by alternating stars over written tables; a round moves every link towards the smallest
member, so their number grows with the logarithm of the longest chain.

Defined cases: null fields count as empty; texts shorter than `least` letters and digits take no part; repeated rows
of one id never pair with themselves; an id with two texts belongs to the groups of both, and a row of the group query names the smaller; an
empty table gives no row; every text is used whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.canon import alnum
from tagloom.runtime import HOT_KEYS, salted_join, table, written

GRAM, ROWS, COORDS, MATCH, SEEN = 4, 3, 32, 4, 2
FREQUENT, LOCAL = 65_536, 4  # frequent values that the driver gets, at most; the least count of one in a block
BLOCK = 1 << 20  # values that a task counts at once
LIST, SALTS = 2_048, 64  # a list longer than LIST is joined in up to SALTS parts
SHIFT = np.uint64(38)  # bits of a posted value: 32 of the min-hash below those of the coordinate's number


def gram_hashes(texts: list[str], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all grams of all texts, one after the other, and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.maximum(lengths - gram + 1, 0)
    if len(cp) < gram:
        return np.empty(0, np.uint32), counts
    h = np.zeros(len(cp) - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[k : len(cp) - gram + 1 + k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    return (h[inside] >> np.uint64(32)).astype(np.uint32), counts


def signatures(texts: list[str], gram: int, coords: int, rows: int) -> np.ndarray:
    """(texts, coords) coordinates, each the mix of `rows` min-hashes."""
    rng = np.random.default_rng(20240501)
    mul = rng.integers(0, 2**31, coords * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, coords * rows, dtype=np.uint32)
    hashes, counts = gram_hashes(texts, gram)
    mins, at = np.full((len(texts), coords * rows), 0xFFFFFFFF, np.uint32), 0
    for i, n in enumerate(counts):
        for lo in range(at, at + n, 4096):  # long texts in pieces that stay in the cache
            x = hashes[lo : min(lo + 4096, at + n), None] * mul
            x += add
            np.minimum(mins[i], x.min(0), out=mins[i])
        at += n
    mixed = np.zeros((len(texts), coords), np.uint64)
    for k in range(rows):
        mixed = (mixed ^ mins[:, k::rows]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def _signed(gram: int, coords: int, rows: int):
    """Mapper (id, c, h, t) -> (id, c, h, sig): sig has coords 32-bit min-hashes; a text repeated in a batch is signed once."""

    def run(batches):
        for b in batches:
            _, first, back = np.unique(b.column(1).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            texts = b.column(3).take(pa.array(first)).to_pylist()
            signed = signatures(texts, gram, coords, rows)[back]
            raw = pa.py_buffer(signed.tobytes())
            sig = pa.Array.from_buffers(pa.binary(4 * coords), len(signed), [None, raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sig], ["id", "c", "h", "sig"])

    return run


def _values(sigs: pa.Array) -> np.ndarray:
    """(texts, coords) posted values: the min-hash with its coordinate's number above it."""
    mins = np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(len(sigs), -1).astype(np.uint64)
    return mins | (np.arange(mins.shape[1], dtype=np.uint64) << np.uint64(32))


def _counted(least: int):
    """Mapper (sig) -> (tok, n): the values that a block of the task holds at least `least` times."""

    def run(batches):
        held: list[np.ndarray] = []

        def out():
            tok, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keep = n >= least
            return pa.RecordBatch.from_arrays([pa.array(tok[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["tok", "n"])

        for b in batches:
            held.append(_values(b.column(0)).ravel())
            if sum(map(len, held)) >= BLOCK:
                yield out()
        if held:
            yield out()

    return run


def frequent(sigs: DataFrame, top: int = FREQUENT, least: int = LOCAL) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of the most frequent posted values, ascending by value; at most `top`, so it may go to the driver and to every task."""
    rows = sigs.select("sig").mapInArrow(_counted(least), "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tok").limit(top).toPandas()
    rows = rows.sort_values("tok")
    return rows["tok"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64)


def _posted(tok: np.ndarray, n: np.ndarray, prefix: int, parts: bool):
    """Mapper (c, sig) -> (c, tok, salts): the first `prefix` values in the common order; of lists joined whole, or else of those joined in parts."""
    rank = np.empty(len(n), np.uint64)
    rank[np.lexsort((tok, n))] = np.arange(1, len(n) + 1, dtype=np.uint64)
    salts = np.r_[1, np.minimum(SALTS, 1 + np.sort(n) // LIST)]

    def run(batches):
        for b in batches:
            v = _values(b.column(1))
            if len(tok):
                at = np.minimum(np.searchsorted(tok, v), len(tok) - 1)
                v = v | (np.where(tok[at] == v, rank[at], np.uint64(0)) << SHIFT)
            first = np.sort(v, axis=1)[:, :prefix]
            s = salts[(first >> SHIFT).astype(np.int64)]
            keep = (s > 1) == parts
            c = np.broadcast_to(b.column(0).to_numpy()[:, None], first.shape)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array((first & ((np.uint64(1) << SHIFT) - np.uint64(1)))[keep].astype(np.int64)), pa.array(s[keep].astype(np.int32))], ["c", "tok", "salts"])

    return run


def _agreeing(match: int):
    """Mapper (.., x, y) -> (..): the rows whose signatures x and y agree in at least `match` coordinates."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(b.num_rows, -1) for k in (b.num_columns - 2, b.num_columns - 1)) if b.num_rows else (np.empty((0, 1)),) * 2
            same = (x == y).sum(1) >= match
            yield b.select(list(range(b.num_columns - 2))).filter(pa.array(same))

    return run


def gram_sets(texts: list[str], gram: int) -> list[np.ndarray]:
    """The distinct grams of each text as ascending numbers, equal for equal grams: characters are numbered within the call, so nothing is hashed.

    At most 65,536 different characters and four a gram."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.zeros(0x110000, bool)
    number[cp] = True
    code = (np.cumsum(number) - 1)[cp].astype(np.uint64)
    g = np.zeros(max(0, len(cp) - gram + 1), np.uint64)
    for k in range(gram):
        g = g << np.uint64(16) | code[k : len(cp) - gram + 1 + k]
    ends = np.cumsum(lengths)
    return [np.unique(g[e - n : max(e - n, e - gram + 1)]) for e, n in zip(ends, lengths)]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int(np.count_nonzero(x[at] == y))
    return both / (len(x) + len(y) - both)


def _verified(gram: int, least: float):
    """Mapper (ca, ha, cb, hb, a, b) -> (ca, ha, cb, hb, similarity) of the pairs of texts at or above the threshold."""

    def scores(a: list[str], b: list[str]) -> list[float]:
        texts = list(dict.fromkeys([*a, *b]))
        if len(set().union(*texts)) > 65_536 and len(a) > 1:
            half = len(a) // 2
            return scores(a[:half], b[:half]) + scores(a[half:], b[half:])
        if gram > 4 or len(set().union(*texts)) > 65_536:
            cut = lambda t: {t[i : i + gram] for i in range(len(t) - gram + 1)}
            sets = {t: cut(t) for t in texts}
            return [len(sets[x] & sets[y]) / max(1, len(sets[x] | sets[y])) for x, y in zip(a, b)]
        sets = dict(zip(texts, gram_sets(texts, gram)))
        return [jaccard(sets[x], sets[y]) for x, y in zip(a, b)]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                part = b.slice(lo, 2_000)
                s = np.array(scores(part.column(4).to_pylist(), part.column(5).to_pylist()))
                out = pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(s)], ["ca", "ha", "cb", "hb", "similarity"])
                yield out.filter(pa.array(s >= least))

    return run


def met(sigs: DataFrame, prefix: int, top: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(c, c2) with c < c2, a row for each list in which the two are posted."""
    post = lambda parts: sigs.select("c", "sig").mapInArrow(_posted(*top, prefix, parts), "c long, tok long, salts int")
    whole = post(False).select("c", "tok").repartition("tok")
    out = whole.join(whole.select(F.col("c").alias("c2"), "tok"), "tok")
    if (top[1] >= LIST).any():
        long_ = post(True)
        left = long_.select("c", "tok", F.pmod(F.xxhash64("c"), "salts").cast("int").alias("salt"))
        right = long_.select(F.col("c").alias("c2"), "tok", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        out = out.unionByName(left.join(right.hint("merge"), ["tok", "salt"]).select("tok", "c", "c2"))
    return out.where("c < c2").select("c", "c2")


def candidates(sigs: DataFrame, coords: int = COORDS, match: int = MATCH, seen: int = SEEN) -> DataFrame:
    """(ca, ha, ia, cb, hb, ib): pairs of classes whose signatures agree in at least `match` coordinates. sigs: (c, h, id, sig)."""
    counted = met(sigs, coords - match + seen, frequent(sigs)).groupBy("c", "c2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen)
    a = sigs.select(F.col("c").alias("ca"), F.col("h").alias("ha"), F.col("id").alias("ia"), F.col("sig").alias("x")).hint("merge")
    b = sigs.select(F.col("c").alias("cb"), F.col("h").alias("hb"), F.col("id").alias("ib"), F.col("sig").alias("y")).hint("merge")
    both = counted.select(F.col("c").alias("ca"), F.col("c2").alias("cb")).join(a, "ca").join(b, "cb").select("ca", "ha", "ia", "cb", "hb", "ib", "x", "y")
    return both.mapInArrow(_agreeing(match), "ca long, ha long, ia string, cb long, hb long, ib string")


def class_signatures(docs: DataFrame, gram: int = GRAM, coords: int = COORDS, rows: int = ROWS) -> DataFrame:
    """(c, h, id, sig): a row for each different text, with one of its ids; written."""
    signed = docs.select("id", "c", "h", "t").mapInArrow(_signed(gram, coords, rows), "id string, c long, h long, sig binary")
    return written(signed.groupBy("c", "h").agg(F.min(F.struct("id", "sig")).alias("one")).select("c", "h", "one.id", "one.sig"), "signatures")


def class_pairs(docs: DataFrame, least: float, gram: int = GRAM, rows: int = ROWS, coords: int = COORDS, match: int = MATCH, seen: int = SEEN) -> DataFrame:
    """(ca, ha, cb, hb, similarity): pairs of different texts at or above the threshold. docs: (id, c, h, t)."""
    near = candidates(class_signatures(docs, gram, coords, rows), coords, match, seen)
    # The id takes part in the key, so that the copies of one text are spread.
    text = lambda s: docs.select(F.col("c").alias(f"c{s}"), F.col("h").alias(f"h{s}"), F.col("id").alias(f"i{s}"), F.col("t").alias(f"t{s}")).hint("merge")
    pairs = near.join(text("a"), ["ca", "ha", "ia"]).join(text("b"), ["cb", "hb", "ib"])
    return pairs.select("ca", "ha", "cb", "hb", "ta", "tb").mapInArrow(_verified(gram, least), "ca long, ha long, cb long, hb long, similarity double").dropDuplicates(["ca", "ha", "cb", "hb"])


def prepared(df: DataFrame, row_id: str, text: Column, least_chars: int) -> DataFrame:
    """(id, c, h, t) of the rows that take part; text is already canonical."""
    rows = df.select(F.col(row_id).cast("string").alias("id"), text.alias("t")).where((F.length("t") >= least_chars) & F.col("id").isNotNull())
    return rows.select("id", F.xxhash64("t").alias("c"), F.xxhash64("t", F.lit("second")).alias("h"), "t")


def members(docs: DataFrame) -> DataFrame:
    return docs.select("id", "c", "h").distinct()


def hot_classes(of: DataFrame) -> DataFrame:
    """The largest classes with more than one id: (c, h), HOT_KEYS at most."""
    return of.groupBy("c", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "c", "h").limit(HOT_KEYS).select("c", "h")


def id_pairs(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: the pairs of ids of class pairs, and of each class with several ids."""
    own = members(docs)
    hot = hot_classes(own)
    side = lambda s: own.select(F.col("id").alias(s), F.col("c").alias(f"c{s}"), F.col("h").alias(f"h{s}"))
    named = lambda s: hot.select(F.col("c").alias(f"c{s}"), F.col("h").alias(f"h{s}"))
    several = own.join(own.groupBy("c", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "h"), ["c", "h"], "left_semi")
    same = salted_join(several.select(F.col("id").alias("x"), "c", "h"), several.select(F.col("id").alias("y"), "c", "h"), ["c", "h"], hot=hot).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    # A hot class is split whichever side of a pair it stands on: its own rows in the first join, the rows made by it in the second.
    left = salted_join(side("a"), classes, ["ca", "ha"], hot=named("a"))
    across = salted_join(left, side("b"), ["cb", "hb"], hot=named("b")).where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity")
    return same.unionByName(across).groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge (a, b), the smallest node that it is connected with.

    Alternating stars: first every node's larger neighbours are linked to the smallest node around it, then its smaller ones and itself.
    A node's smallest neighbour is aggregated map-side, and links of a hot node are joined in salted parts. Each round is a written table."""
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, ["a"])
        now = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")


def _node(c: str, h: str) -> Column:
    return F.concat(F.lpad(F.hex(c), 16, "0"), F.lpad(F.hex(h), 16, "0"))


def groups(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links), a row for each id of docs: the smallest id with its text, the smallest id of its group (texts connected by pairs),
    and the number of different texts that are similar to its own. No pair of ids is made."""
    classes = written(classes.select(_node("ca", "ha").alias("a"), _node("cb", "hb").alias("b")), "classes")
    ends = classes.unionByName(classes.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("a", "node")
    own = members(docs).select("id", _node("c", "h").alias("node"))
    known = own.groupBy("node").agg(F.min("id").alias("class_id")).join(components(classes), "node", "left").join(degree, "node", "left")
    known = known.select("node", "class_id", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = known.join(known.groupBy("root").agg(F.min("class_id").alias("group_id")), "root").select("node", "class_id", "group_id", "n_links")
    rows = salted_join(own, known, ["node"])
    return rows.groupBy("id").agg(F.min(F.struct("group_id", "class_id", "n_links")).alias("r")).select("id", "r.class_id", "r.group_id", "r.n_links")


#: p4: the least similarity and length (letters and digits).
SIMILAR, LEAST = 0.70, 120


def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that take part, brought to their canonical form once and written."""
    units = table(spark, d, "label_units")
    return written(prepared(units, "question_id", alnum(F.concat(F.coalesce("stem", F.lit("")), F.coalesce("analysis", F.lit("")))), LEAST), "texts")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs = unit_texts(spark, d)
    return id_pairs(docs, class_pairs(docs, SIMILAR)).select("id_a", "id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every question that takes part, with its class, its group and its number of links."""
    docs = unit_texts(spark, d)
    return groups(docs, class_pairs(docs, SIMILAR)).withColumnRenamed("id", "question_id")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of different texts, each named by its smallest question_id."""
    docs = unit_texts(spark, d)
    named = docs.groupBy("c", "h").agg(F.min("id").alias("n"))
    one = lambda s: named.select(F.col("c").alias(f"c{s}"), F.col("h").alias(f"h{s}"), F.col("n").alias(f"n{s}")).hint("merge")
    pairs = class_pairs(docs, SIMILAR).join(one("a"), ["ca", "ha"]).join(one("b"), ["cb", "hb"])
    return pairs.select(F.least("na", "nb").alias("class_a"), F.greatest("na", "nb").alias("class_b"), F.round("similarity", 6).alias("similarity"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups, "p4_links": p4_links}
_TEXTS = rf"with recursive t as (select question_id, regexp_replace(lower(coalesce(stem, '') || coalesce(analysis, '')), '[^\p{{L}}\p{{N}}]+', '', 'g') x from label_units where length(x) >= {LEAST})"
_GRAMS = rf"g as (select distinct {{id}}, unnest([substr(x, i, {GRAM}) for i in range(1, length(x) - {GRAM - 2})]) g from {{source}}), n as (select {{id}}, count(*) n from g group by 1)"
_CLASSES = f"""{_TEXTS}, k as (select x, min(question_id) class_id from t group by 1), {_GRAMS.format(id='class_id', source='k')},
p as (select a.class_id class_a, b.class_id class_b, count(*) k from g a join g b on a.g = b.g and a.class_id < b.class_id group by 1, 2),
links as (select class_a, class_b, round(k / (a.n + b.n - k), 6) similarity from p join n a on a.class_id = class_a join n b on b.class_id = class_b where k >= {SIMILAR} * (a.n + b.n - k))"""
ORACLES = {
    "p4_found": rf"""{_TEXTS},
{_GRAMS.format(id='question_id', source='t')},
p as (select a.question_id id_a, b.question_id id_b, count(*) k from g a join g b on a.g = b.g and a.question_id < b.question_id group by 1, 2)
select id_a, id_b from p join n a on a.question_id = id_a join n b on b.question_id = id_b where k >= {SIMILAR} * (a.n + b.n - k)""",
    "p4_links": f"{_CLASSES} select * from links",
    "p4_groups": f"""{_CLASSES}, e as (select class_a a, class_b b from links union all select class_b, class_a from links),
r as (select class_id a, class_id b from k union select r.a, e.b from r join e on e.a = r.b),
m as (select a class_id, min(b) group_id from r group by 1)
select question_id, class_id, group_id, (select count(*) from e where a = class_id) n_links from t join k using (x) join m using (class_id)""",
}
