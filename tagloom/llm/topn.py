"""The N best items of every group, exact under any skew.

The rows are sorted globally: range-partitioned on (group, score descending, item) and sorted within partitions, so a
group with a third of all rows lies over many partitions. Each partition numbers its rows within each group and keeps
numbers up to N. Only a partition's first and last group can go on in another partition; their counts, at most two rows
a partition, are prefix-summed in partition order and added, which gives the exact global positions.

Defined cases: rows with a null item or a null or NaN score are ignored; a repeated item counts once with its highest
score; ties go by item ascending; -0.0 equals 0.0; a null group is a group of its own; an empty input gives no row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.runtime import table, written


def _numbered(n: int, names: list[str]):
    """Mapper over sorted partitions: rows with their number in the group (1..n), the partition and whether another partition may have more of the group."""

    def run(batches):
        pid, before, seen, first, held = TaskContext.get().partitionId(), None, 0, True, None

        def out(rows: pa.Table, edge: bool):
            for b in rows.append_column("_edge", pa.array([edge] * len(rows))).append_column("_pid", pa.array([pid] * len(rows), pa.int32())).select([*names, "_local", "_pid", "_edge"]).combine_chunks().to_batches():
                yield b

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            values, codes = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            values = {**dict(enumerate(values)), -1: None}
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            sizes = np.diff(np.r_[starts, len(codes)])
            local = np.arange(len(codes)) - np.repeat(starts, sizes) + 1
            same = before is not None and before[0] == values[int(codes[0])]
            if same:
                local[: sizes[0]] += seen
            keep = local <= n
            t = pa.Table.from_batches([batch]).append_column("_local", pa.array(local, pa.int64()))
            # [head: the group held back goes on][middle][last group: held back]
            ends = np.cumsum(sizes)
            if held is not None and not same:
                yield from out(held, first)
                held, first = None, False
            last = len(starts) - 1
            for lo, hi, k in ((0, int(starts[last]) if last else 0, "body"), (int(starts[last]), len(codes), "last")):
                if k == "body" and hi:
                    cut = int(ends[0])
                    head, rest = t.slice(0, cut).filter(pa.array(keep[:cut])), t.slice(cut, hi - cut).filter(pa.array(keep[cut:hi]))
                    yield from out(pa.concat_tables([held, head]) if held is not None else head, first)
                    held, first = None, False
                    yield from out(rest, False)
                elif k == "last":
                    tail = t.slice(lo, hi - lo).filter(pa.array(keep[lo:hi]))
                    held = pa.concat_tables([held, tail]) if held is not None else tail
            before, seen = (values[int(codes[-1])],), int(local[-1])
        if held is not None:
            yield from out(held, True)

    return run


def top_n(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """(group, item, score, position): the n best distinct items of each group, position from 1."""
    value = F.col(score).cast("double") + F.lit(0.0)
    best = df.where(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(value)).groupBy(group, item).agg(F.max(value).alias(score))
    order = [F.col(group).asc_nulls_first(), F.col(score).desc(), F.col(item).asc()]
    ordered = best.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("_local", T.LongType()), T.StructField("_pid", T.IntegerType()), T.StructField("_edge", T.BooleanType())])
    # Written, since counts and positions must see the same partitions: at most n rows a group and partition.
    kept = written(ordered.mapInArrow(_numbered(n, ordered.columns), schema), "topn")
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = kept.where("_edge").groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n")).select(F.col(group).alias("_g"), F.col("_pid").alias("_p"), before.alias("_before")).where("_before is not null")
    exact = kept.join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p")), "left")
    return exact.select(group, item, score, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("position")).where(F.col("position") <= n)


#: How many labels p1 keeps a question.
TOP = 5


def best_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "candidates").select("question_id", F.inline("candidates"))
    return top_n(labels.select("question_id", "label_id", "score"), "question_id", "score", "label_id", TOP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return best_labels(spark, d).select("question_id", "label_id")


def p1_positions(spark: SparkSession, d: str) -> DataFrame:
    return best_labels(spark, d)


_SQL = """with e as (select question_id, unnest(candidates) c from candidates),
b as (select question_id, c.label_id label_id, max(c.score) score from e where c.label_id is not null and c.score is not null and not isnan(c.score) group by all),
r as (select *, row_number() over (partition by question_id order by score desc, label_id) "position" from b)"""
QUERIES = {"p1_found": p1_found, "p1_positions": p1_positions}
ORACLES = {
    "p1_found": f"{_SQL} select question_id, label_id from r where \"position\" <= {TOP}",
    "p1_positions": f"{_SQL} select question_id, label_id, score, \"position\" from r where \"position\" <= {TOP}",
}
