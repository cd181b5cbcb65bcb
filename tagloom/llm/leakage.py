"""Evaluation texts leaking into training text.

Texts are reduced to letters and digits. Windows of WINDOW characters start at anchors that the content itself picks (the least gram
hash of every ANCHOR_RUN successive grams), so a passage that stands in two texts has the same anchors in both, wherever it stands, and about a
tenth of all positions is looked at. Every window is embedded by CGK random walks (the walk moves on or stays by a random bit of the step and the
character), which turns a small edit distance into a small Hamming distance; bit-sampling LSH, repeated REPEATS times, meets the windows of
the items. Windows that meet are verified by their exact edit distance (at most EDITS), and equal windows are extended to the longest
common stretch.

Guarantee: a common stretch of at least WINDOW + ANCHOR_RUN - 1 characters holds a common anchor window, and equal windows meet in every
repetition, so such stretches are all found. With edits, recall is a matter of chance and measured end to end, anchors included: at least 0.9 for passages
of SURE characters and more (the shortest item has as many) with up to EDITS edits anywhere in them, and for passages of 50 characters with one edit. Windows
are shorter than items since a part of 50 characters is a case.

The items are taken in blocks of about BLOCK_CHARS characters; a block's index is what each task gets. One block is held at a time: its
result is written before the next is collected, so the driver's and the tasks' memory don't grow with the number of items, and the documents are scanned once a
block. No document is shuffled: only found pairs are. A window that many items share is indexed, met and compared once.

Defined cases: null text counts as empty; texts and items shorter than WINDOW letters and digits meet nothing; repeated documents and
items give one row each (id, item); null ids are left out; an empty table gives no row; texts are used whole."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.canon import alnum
from tagloom.runtime import spread, table, written

WINDOW, GRAM, ANCHOR_RUN = 32, 8, 19
WALKS, SAMPLES, BITS = 2, 4, 10
REPEATS = WALKS * SAMPLES
EDITS = 4
SURE = 70
BLOCK_CHARS = 4_000_000
CHUNK = 1_000_000  # characters that a task looks at at once
BLOCK = 8_192  # windows whose walks go on together, so that they stay in the cache


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of all texts as numbers, and where each text ends."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def anchors(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the anchor windows that lie within one text, and that text's number."""
    n = len(cp) - GRAM - ANCHOR_RUN + 2
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(len(cp) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[k : len(cp) - GRAM + 1 + k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    run = np.arange(n)
    whole = run + ANCHOR_RUN + GRAM - 1 <= ends[np.searchsorted(ends, run, "right")]  # runs that lie in one text, so its neighbours don't matter
    least = np.lib.stride_tricks.sliding_window_view(h, ANCHOR_RUN).argmin(1) + run
    starts = np.unique(least[whole])
    of = np.searchsorted(ends, starts, "right")
    inside = starts + WINDOW <= ends[np.minimum(of, len(ends) - 1)]
    return starts[inside], of[inside]


def lsh_keys(cp: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """One 64-bit key per window for each repetition: BITS sampled positions of a CGK embedding.

    A walk moves on by a half a step, so its first 2 * WINDOW positions hold the window; those are sampled."""
    rng, steps = np.random.default_rng(7), 2 * WINDOW
    walks = [(rng.integers(1, 2**32, steps, dtype=np.uint32) | np.uint32(1), [set(rng.choice(steps, BITS, replace=False).tolist()) for _ in range(SAMPLES)]) for _ in range(WALKS)]
    out = [np.zeros(len(starts), np.uint64) for _ in range(REPEATS)]
    for lo in range(0, len(starts), BLOCK):
        part = starts[lo : lo + BLOCK]
        # A 0 behind each window ends the walk: its step is 0.
        chars = np.zeros((len(part), WINDOW + 1), np.uint32)
        chars[:, :WINDOW] = cp[part[:, None] + np.arange(WINDOW)]
        flat, first = chars.ravel(), np.arange(len(part), dtype=np.int64) * (WINDOW + 1)
        for w, (mul, picked) in enumerate(walks):
            keys = [k[lo : lo + BLOCK] for k in out[w * SAMPLES : (w + 1) * SAMPLES]]
            at = first.copy()
            for j in range(max(max(p) for p in picked) + 1):
                c = flat[at]
                for key, p in zip(keys, picked):
                    if j in p:
                        key ^= c
                        key *= np.uint64(0xC2B2AE3D27D4EB4F)
                        key ^= key >> np.uint64(29)
                at += (c * mul[j]) >> np.uint32(31)
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors (one word a row)."""
    if a == b:
        return 0
    bits: dict[str, int] = {}
    for i, ch in enumerate(a):
        bits[ch] = bits.get(ch, 0) | 1 << i
    full, top, plus, minus, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for ch in b:
        eq = bits.get(ch, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diag | plus) & full, plus & diag
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(diag | up) & full, up & diag
    return score


class Index:
    """Item windows by LSH key. Arrays only, so it travels to the tasks as it is."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.texts = ids, texts
        self.cp, self.ends = codes(texts)
        self.starts, self.of = anchors(self.cp, self.ends)
        self.windows = np.bincount(self.of, minlength=len(ids))
        # Each different window once; its places are starts[places[first[u]:first[u + 1]]].
        chars = np.ascontiguousarray(self.cp[self.starts[:, None] + np.arange(WINDOW)]) if len(self.starts) else np.empty((0, WINDOW), np.uint32)
        _, one, same = np.unique(chars.view(np.dtype((np.void, 4 * WINDOW))).ravel(), return_index=True, return_inverse=True)
        self.places, self.first = np.argsort(same, kind="stable"), np.r_[0, np.cumsum(np.bincount(same, minlength=len(one)))].astype(np.int64)
        self.keys, self.rows, self.seen = [], [], []
        for key in lsh_keys(self.cp, self.starts[one]):
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.rows.append(order)
            seen = np.zeros(1 << 22, bool)
            seen[(key >> np.uint64(42)).astype(np.int64)] = True
            self.seen.append(seen)

    def meet(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document window, different item window) pairs that share a key."""
        left, right, n_windows = [], [], max(1, len(self.first) - 1)
        for key, mine, rows, seen in zip(lsh_keys(cp, starts), self.keys, self.rows, self.seen):
            some = np.flatnonzero(seen[(key >> np.uint64(42)).astype(np.int64)])
            lo, hi = np.searchsorted(mine, key[some], "left"), np.searchsorted(mine, key[some], "right")
            n = hi - lo
            left.append(np.repeat(some, n))
            right.append(rows[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)])
        pairs = np.unique(np.concatenate(left) * n_windows + np.concatenate(right)) if left else np.empty(0, np.int64)
        return pairs // n_windows, pairs % n_windows

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, longest common stretch, item windows verified, least edits) of all texts."""
        cp, ends = codes(texts)
        starts, of = anchors(cp, ends)
        if not len(starts) or not len(self.starts):
            return []
        w, u = self.meet(cp, starts)
        found: dict[tuple[int, int], list] = {}
        begin = ends - np.diff(np.r_[0, ends])
        known: dict[tuple[str, int], int] = {}
        for d, p, v in zip(of[w].tolist(), starts[w].tolist(), u.tolist()):
            p -= int(begin[d])
            text = texts[d]
            places = self.places[self.first[v] : self.first[v + 1]].tolist()
            i, q = self._place(places[0])
            both = text[p : p + WINDOW], v
            if (e := known.get(both)) is None:
                e = known[both] = edit_distance(both[0], self.texts[i][q : q + WINDOW])
            if e > EDITS:
                continue
            for x in places:
                i, q = self._place(x)
                f = found.setdefault((d, i), [0, set(), e, set()])
                f[1].add(x)
                f[2] = min(f[2], e)
                if e == 0 and (p - q) not in f[3]:
                    f[3].add(p - q)
                    f[0] = max(f[0], self._stretch(text, self.texts[i], p - q))
        return [(d, i, f[0], len(f[1]), f[2]) for (d, i), f in found.items()]

    def _place(self, x: int) -> tuple[int, int]:
        """The item of an item window and where it begins there."""
        i = int(self.of[x])
        return i, int(self.starts[x]) - int(self.ends[i]) + len(self.texts[i])

    @staticmethod
    def _stretch(text: str, item: str, shift: int) -> int:
        """The longest run of equal characters of text[shift:] and item, laid side by side."""
        lo, hi = max(0, shift), min(len(text), len(item) + shift)
        a, b = text[lo:hi], item[lo - shift : hi - shift]
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        cuts = np.flatnonzero(np.r_[True, x != y, True])
        return int(np.diff(cuts).max()) - (1 if len(cuts) > 1 else 0)


def _search(index: Index):
    """Mapper (id, text) -> (id, item, stretch, windows, item_windows, edits)."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= CHUNK):
                    chars += len(texts[hi])
                    hi += 1
                rows = [(ids[lo + d], index.ids[i], s, n, int(index.windows[i]), e) for d, i, s, n, e in index.search(texts[lo:hi])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["id", "item", "stretch", "windows", "item_windows", "edits"])
                lo = hi

    return run


def leaks(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str = "text") -> DataFrame:
    """(doc_id, item_id, stretch, windows, item_windows, edits): documents with a passage of an item.

    stretch: longest common run of letters and digits among equal windows (0 if all windows have edits); windows of item_windows were
    found with at most EDITS edits; edits: the least of them. Ids are bigint."""
    # Only an item's windows and ids go to the tasks, a block at a time.
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), alnum(text).alias("t")).where((F.length("t") >= WINDOW) & F.col("i").isNotNull())
    size = rows.agg(F.sum(F.length("t")).alias("n")).first().n or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    corpus = spread(docs.select(F.col(doc_id).cast("bigint").alias("d"), text)).select("d", alnum(text).alias("t")).where((F.length("t") >= WINDOW) & F.col("d").isNotNull())
    schema = "id long, item long, stretch long, windows long, item_windows long, edits long"
    parts = []
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i").collect()
        part = corpus.mapInArrow(_search(Index([r.i for r in block], [r.t for r in block])), schema)
        parts.append(written(part, "leaks") if blocks > 1 else part)
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("id", "item").agg(F.max("stretch").alias("stretch"), F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.min("edits").alias("edits"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "stretch", "windows", "item_windows", "edits")


#: p9: the least common stretch.
STRETCH = 50


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), "doc_id", table(spark, d, "eval_items"), "item_id")
    return found.where(F.col("stretch") >= STRETCH).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: documents with a stretch, and with windows at few edits only."""
    found = leaks(table(spark, d, "documents"), "doc_id", table(spark, d, "eval_items"), "item_id")
    return found.groupBy("item_id").agg(F.count_if(F.col("stretch") >= STRETCH).alias("documents"), F.count_if(F.col("stretch") < STRETCH).alias("documents_edited"), F.max("stretch").alias("longest"))


def p9_item_documents(spark: SparkSession, d: str) -> DataFrame:
    """Per item, the number of documents with a stretch of it."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items, "p9_item_documents": p9_item_documents}
_WINDOWS = lambda source, key: rf"select distinct {key}, unnest([substr(x, i, {STRETCH}) for i in range(1, length(x) - {STRETCH - 2})]) w from (select {key}, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', '', 'g') x from {source})"
_FOUND = f"select distinct doc_id, item_id from ({_WINDOWS('documents', 'doc_id')}) d join ({_WINDOWS('eval_items', 'item_id')}) i on d.w = i.w"
ORACLES = {"p9_found": _FOUND, "p9_item_documents": f"select item_id, count(*) documents from ({_FOUND}) group by 1"}
