"""Duplicates hidden by formatting differences: one record each, with its number of copies.

Each record's fields are brought to a canonical form (lower case, letters and digits only, option lines in an order of
their own) in JVM expressions, hashed to 128 bits, and counted by hash with map-side combining, so a group of copies with a
third of all rows is one row a task before the shuffle. Collision check: a second 64-bit hash and the length take part
in the key, so two texts under one 128-bit hash come out as two groups, and the report counts such hashes.

Defined cases: null fields count as empty; a record whose first field has no letter or digit is in no group; repeated
rows of one id count as copies in n_copies and never pair an id with itself; an empty table gives no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.canon import alnum, line_set
from tagloom.runtime import HOT_KEYS, salted_join, table, written

KEY = ["h128", "h64", "chars"]


def keyed(df: DataFrame, row_id: str, fields: list[Column], first: Column) -> DataFrame:
    """(row id, h128, h64, chars): canonical fields hashed; rows whose `first` is empty are left out."""
    text = F.concat_ws("\x01", *fields)
    rows = df.select(F.col(row_id), first.alias("_f"), text.alias("_t")).where("_f <> ''")
    return rows.select(row_id, F.unhex(F.md5("_t")).alias("h128"), F.xxhash64("_t").alias("h64"), F.length("_t").alias("chars"))


def copy_groups(keys: DataFrame, row_id: str) -> DataFrame:
    """(h128, h64, chars, keep_id, n_copies): one row per canonical record."""
    return keys.groupBy(*KEY).agg(F.min(row_id).alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))


def copies(keys: DataFrame, row_id: str) -> DataFrame:
    """(keep_id, copy_id) for every row that is a copy of another id's record."""
    groups = copy_groups(keys, row_id).where("n_copies > 1")
    hot = groups.orderBy(F.desc("n_copies")).limit(HOT_KEYS)
    both = salted_join(keys, groups, KEY, hot=hot)
    return both.where(F.col(row_id) != F.col("keep_id")).select("keep_id", F.col(row_id).alias("copy_id"))


def unit_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of label_units, made once and written: ids and hashes, no text."""
    return written(keyed(table(spark, d, "label_units"), "question_id", [alnum("stem"), alnum("answer_text"), line_set("options")], alnum("stem")), "keys")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(unit_keys(spark, d), "question_id").distinct()


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the id kept, its number of copies, and whether its 128-bit hash stands for another text too."""
    groups = copy_groups(unit_keys(spark, d), "question_id")
    clash = groups.groupBy("h128").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h128", F.lit(True).alias("hash_clash"))
    return groups.join(clash, "h128", "left").select("keep_id", "n_copies", F.coalesce("hash_clash", F.lit(False)).alias("hash_clash"))


_SQL = r"""with k as (select question_id, regexp_replace(lower(coalesce(stem, '')), '[^\p{L}\p{N}]+', '', 'g') a, regexp_replace(lower(coalesce(answer_text, '')), '[^\p{L}\p{N}]+', '', 'g') b,
  list_sort(list_filter(list_transform(regexp_split_to_array(coalesce(options, ''), '\r\n|[\n\r]'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')) o from label_units),
g as (select a, b, o, min(question_id) keep_id, count(*) n_copies from k where a <> '' group by all)"""
QUERIES = {"p3_found": p3_found, "p3_records": p3_records}
ORACLES = {
    "p3_found": f"{_SQL} select distinct keep_id, question_id copy_id from g join k using (a, b, o) where question_id <> keep_id",
    "p3_records": f"{_SQL} select keep_id, n_copies, false hash_clash from g",
}
