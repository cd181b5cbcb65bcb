"""Filling fixed-capacity sequences with documents by minimum bin slack.

Documents are measured in tokens where they are read; only (id, tokens) moves on. The sizes are dealt evenly into shards of
about SHARD documents (round robin, so no key can make a shard large), and each shard is packed by itself: a bin takes the
largest item left and then the fullest feasible combination of the others, found by a subset-sum over the sizes left, as bits of
one integer; the combination is removed and the next bin begun. A shard of thousands of items leaves slack in its last bins only.

Only a document above the capacity is cut: into full sequences, and a rest that is an item like others.

Defined cases: null or empty texts have no tokens and are listed with n_tokens 0, in the shard's first bin; repeated rows are items of
their own; null ids are kept; an empty table gives no row; texts are measured whole."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import spread, table, written

CAPACITY, SHARD = 2048, 10_000
#: The folder of the public tokenizers' vocabulary files and the one used; both are parameters.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the tokenizer's source splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_tokenizer(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _measured(path: str):
    """Mapper (id, text) -> (id, n)."""

    def run(batches):
        encoding = None
        for b in batches:
            encoding = encoding or load_tokenizer(path)
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["id", "n"])

    return run


def token_counts(df: DataFrame, row_id: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, n): tokens of each text."""
    kind = df.schema[row_id].dataType.simpleString()
    return spread(df.select(F.col(row_id).alias("id"), text)).mapInArrow(_measured(path), f"id {kind}, n long")


def fullest(sizes: list[tuple[int, int]], room: int) -> list[int]:
    """The sizes of a feasible combination with the largest sum up to room. sizes: (size, how many), sizes descending."""
    reach, mask, target, steps = 1, (1 << room + 1) - 1, 1 << room, []
    for size, many in sizes:
        if size > room:
            continue
        for _ in range(min(many, room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            steps.append((size, reach))
            reach = more
            if reach & target:
                break
        if reach & target:
            break
    total, taken = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> total & 1:
            taken.append(size)
            total -= size
    return taken


def pack(items: list[tuple], capacity: int) -> list[tuple]:
    """items: (n, payload). (bin, offset, n, payload) with bins from 0."""
    left: dict[int, list] = defaultdict(list)
    out, bins = [], 0
    for n, payload in sorted(items, key=lambda x: x[0], reverse=True):
        if n == 0:
            out.append((0, 0, 0, payload))
        else:
            left[n].append(payload)
    order = list(left)  # descending
    while order:
        first = order[0]
        at = 0
        chosen = [first]
        payloads = [left[first].pop()]
        rest = [(n, len(left[n])) for n in order if left[n]]
        for n in fullest(rest, capacity - first):
            chosen.append(n)
            payloads.append(left[n].pop())
        for n, p in zip(chosen, payloads):
            out.append((bins, at, n, p))
            at += n
        bins += 1
        if any(not left[n] for n in set(chosen)):
            order = [n for n in order if left[n]]
    return out


def _packed(capacity: int, shard: int):
    """Mapper over shards (id, n) -> (id, piece, start, n_tokens, bin, offset)."""

    def flush(rows: list[tuple], first_bin: int):
        items = []
        for i, (row, n) in enumerate(rows):
            whole = n // capacity if n > capacity else 0
            items += [(capacity, (i, k, k * capacity)) for k in range(whole)]
            if n - whole * capacity or not n:
                items.append((n - whole * capacity, (i, whole, whole * capacity)))
        done = pack(items, capacity)
        top = max((b for b, *_ in done), default=-1) + 1
        return [(rows[p[0]][0], p[1], p[2], n, first_bin + b, at) for b, at, n, p in done], first_bin + top

    def run(batches):
        rows, nxt, kind = [], TaskContext.get().partitionId() << 32, None

        def out(cols):
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "piece", "start", "n_tokens", "bin", "offset"])

        for b in batches:
            kind = b.schema.field(0).type
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            while len(rows) >= 2 * shard:
                done, nxt = flush(rows[:shard], nxt)
                rows = rows[shard:]
                yield out(list(zip(*done)))
        if rows:
            done, nxt = flush(rows, nxt)
            yield out(list(zip(*done)))

    return run


def packed(sizes: DataFrame, rows: int, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(id, piece, start, n_tokens, bin, offset) of sizes (id, n): which sequence each document, or piece of a long one, goes to.

    rows: about how many rows sizes has; it sets the number of shards."""
    kind = sizes.schema["id"].dataType.simpleString()
    return sizes.repartition(max(1, -(-rows // shard))).mapInArrow(_packed(capacity, shard), f"id {kind}, piece long, start long, n_tokens long, bin long, offset long")


def pack_documents(docs: DataFrame, row_id: str, text: str, capacity: int = CAPACITY, path: str = f"{TOKENIZERS}/{VOCABULARY}", shard: int = SHARD) -> DataFrame:
    return packed(token_counts(docs, row_id, text, path), docs.count(), capacity, shard)


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sequences, tokens, unused tokens and pieces of the whole packing."""
    bins = p8_packing(spark, d).groupBy("bin").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return bins.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"), F.sum(F.lit(CAPACITY) - F.col("used")).alias("unused"), F.sum("pieces").alias("pieces"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every packing, counted over all documents and sequences: each document placed with all its tokens and without gaps, nothing cut that fits,
    no sequence overfull or with pieces that overlap, and at most a hundredth of the sequences (and one a shard) more than the tokens need."""
    docs = table(spark, d, "documents")
    n = docs.count()
    sizes = written(token_counts(docs, "doc_id", "text"), "sizes")
    rows = written(packed(sizes, n), "packed")
    own = sizes.groupBy("id").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.lag(F.col("start") + F.col("n_tokens")).over(Window.partitionBy("id").orderBy("piece")), F.lit(0))
    pieces = rows.withColumn("gap", F.col("start") != before).groupBy("id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max("gap").alias("gap"))
    j = own.join(pieces, own["id"].eqNullSafe(pieces["id"]), "full")
    per_doc = j.agg(F.count(pieces["pieces"]).alias("placed"), F.count_if(~F.col("n").eqNullSafe(F.col("placed"))).alias("wrong_tokens"), F.count_if(F.coalesce("gap", F.lit(False))).alias("gaps"), F.count_if((F.col("n") <= CAPACITY) & (F.col("pieces") > 1)).alias("needless_cuts"))
    behind = F.coalesce(F.lag(F.col("offset") + F.col("n_tokens")).over(Window.partitionBy("bin").orderBy("offset", "n_tokens")), F.lit(0))
    bins = rows.withColumn("wrong", F.col("offset") != behind).where("n_tokens > 0").groupBy("bin").agg(F.sum("n_tokens").alias("used"), F.max("wrong").alias("wrong"))
    least = F.ceil(F.sum("used") / CAPACITY)
    per_bin = bins.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), F.count_if("wrong").alias("overlapping"), (F.count(F.lit(1)) <= least * 1.01 + max(1, -(-n // SHARD))).alias("well_filled"))
    of_bins = per_bin.first().asDict()  # one row
    return per_doc.select(F.lit(n).cast("bigint").alias("documents"), *per_doc.columns, *(F.lit(v).cast("boolean" if c == "well_filled" else "bigint").alias(c) for c, v in of_bins.items()))


QUERIES = {"p8_packing": p8_packing, "p8_fill": p8_fill, "p8_invariants": p8_invariants}
#: The invariants as constants: only the number of documents is the table's.
ORACLES = {"p8_invariants": "select count(*) documents, count(*) placed, 0::bigint wrong_tokens, 0::bigint gaps, 0::bigint needless_cuts, 0::bigint overfull, 0::bigint overlapping, true well_filled from documents"}
