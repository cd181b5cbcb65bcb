"""References to records that do not exist.

References and parent keys are brought to one (kind, key) space, co-partitioned and sorted on it, and merged linearly
(a sort-merge join). Parent rows are first folded into the disjoint intervals in which a key was valid (its lives), once within each
partition and once a key, so the merge meets one parent row a key and a key with very many rows is no single list. Keys that many references share are
salted (runtime.salted_join).

The time of a reference is compared with the lives of its key: living (a row of the key is not deleted, and the key was valid when the reference was made), late (it is
living, but was not valid yet, or not again), deleted (no living row is left), stale (deleted already before the reference was made), missing (no row at all).

Defined cases: a null or blank reference is none; spaces and tabs around it are cut off; a null parent key is no target;
a parent row is deleted if its end is not null; a null start is before all times; a reference without a time counts as made while its key was valid; an interval that
ends before it begins covers no time but is a row of its key; repeated references give one row each time they differ in a column, and the
queries make rows distinct; an empty parent table makes every reference missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import salted_join, table

MISSING, DELETED, STALE, LATE, LIVING = "missing", "deleted", "stale", "late", "living"


def cut(ref: str | Column) -> Column:
    """The reference without spaces and tabs around it; null where nothing is left."""
    return F.nullif(F.btrim(F.col(ref) if isinstance(ref, str) else ref, F.lit(" \t")), F.lit(""))


def references(df: DataFrame, table_name: str, field: str, ref: Column, row_id: str, at: str, kind: str) -> DataFrame:
    """The reference stream of one field: (table_name, ref_field, ref_at, row_id, kind, ref_key). ref may be an array column."""
    array = df.select(ref.alias("r")).schema["r"].dataType.simpleString().startswith("array")
    own = df.select(F.col(row_id).alias("row_id"), F.col(at).alias("ref_at"), (F.explode(ref) if array else ref).alias("r"))
    return own.select(F.lit(table_name).alias("table_name"), F.lit(field).alias("ref_field"), "ref_at", "row_id", F.lit(kind).alias("kind"), cut("r").alias("ref_key")).where("ref_key is not null")


def parents(df: DataFrame, kind: str, key: str, start: str, end: str | None = None) -> DataFrame:
    """The parent stream of one target table: (kind, ref_key, valid_from, valid_to), a row of the table each."""
    to = F.col(end) if end else F.lit(None)
    return df.where(F.col(key).isNotNull()).select(F.lit(kind).alias("kind"), F.col(key).alias("ref_key"), F.col(start).alias("valid_from"), to.cast(df.schema[start].dataType).alias("valid_to"))


def _merged(lives: Column) -> Column:
    """Overlapping and touching intervals of an array<struct(f, t)> as one each; a null f is the beginning of time, a null t no end."""
    joins = lambda last, x: last["t"].isNull() | x["f"].isNull() | (last["t"] >= x["f"])
    end = lambda x, y: F.when(x.isNull() | y.isNull(), None).otherwise(F.greatest(x, y))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["f"].alias("f"), end(last["t"], x["t"]).alias("t"))))
        return F.when(F.size(done) == 0, F.array(x)).when(joins(last, x), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(lives), F.slice(lives, 1, 0), step)


def validity(stream: DataFrame) -> DataFrame:
    """(kind, ref_key, lives): the disjoint intervals in which a key was valid, in order."""
    rows = stream.select("kind", "ref_key", F.struct(F.col("valid_from").alias("f"), F.col("valid_to").alias("t")).alias("x"), F.spark_partition_id().alias("part"))
    near = rows.groupBy("kind", "ref_key", "part").agg(_merged(F.collect_set("x")).alias("lives"))
    return near.groupBy("kind", "ref_key").agg(_merged(F.flatten(F.collect_list("lives"))).alias("lives"))


def reference_status(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs with the lives of their key and `status` (missing, deleted, stale, late, living)."""
    merged = salted_join(refs, validity(targets), ["kind", "ref_key"], "left", merge=True)
    at = F.col("ref_at")
    covered = at.isNull() | F.exists("lives", lambda x: (x["f"].isNull() | (x["f"] <= at)) & (x["t"].isNull() | (at < x["t"])))
    living = F.exists("lives", lambda x: x["t"].isNull())
    over = F.forall("lives", lambda x: x["t"] <= at)
    status = F.when(F.col("lives").isNull(), MISSING).when(living, F.when(covered, LIVING).otherwise(LATE)).when(~covered & over, STALE).otherwise(DELETED)
    return merged.withColumn("status", status)


def orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_name, ref_field, period, row_id, ref_key, status) of every reference without a living target."""
    gone = reference_status(refs, targets).where(F.col("status").isin(MISSING, DELETED, STALE))
    return gone.select("table_name", "ref_field", F.date_format("ref_at", "yyyy-MM").alias("period"), "row_id", "ref_key", "status").distinct()


def orphan_report(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts of each status by table, field and month."""
    period = F.date_format("ref_at", "yyyy-MM").alias("period")
    one = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return reference_status(refs, targets).groupBy("table_name", "ref_field", period).agg(F.count(F.lit(1)).alias("n_refs"), *map(one, (MISSING, DELETED, STALE, LATE, LIVING)))


# --- the project's tables ---------------------------------------------------


def _project_streams(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    units, raw = table(spark, d, "label_units"), table(spark, d, "raw_question")
    own = units.where(~cut("parent_id").eqNullSafe(F.col("question_id")))
    refs = (
        references(units, "label_units", "legacy_knw_ids", F.col("legacy_knw_ids"), "question_id", "built_at", "label")
        .unionByName(references(units, "label_units", "legacy_unmatched_ids", F.col("legacy_unmatched_ids"), "question_id", "built_at", "label"))
        .unionByName(references(own, "label_units", "parent_id", F.col("parent_id"), "question_id", "built_at", "plan"))
        .unionByName(references(raw, "raw_question", "parent_id", F.col("parent_id"), "question_id", "ingested_at", "raw"))
    )
    targets = (
        parents(table(spark, d, "label_catalog"), "label", "label_id", "added_at", "retired_at")
        .unionByName(parents(table(spark, d, "parent_plan"), "plan", "question_id", "created_at", "deleted_at"))
        .unionByName(parents(raw, "raw", "question_id", "ingested_at"))
    )
    return refs, targets


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans(*_project_streams(spark, d))
    return found.select("table_name", "ref_field", "period", F.col("row_id").alias("question_id"), "ref_key").distinct()


def p2_status_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(*_project_streams(spark, d))


_REFS = """refs as (
  select 'label_units' table_name, 'legacy_knw_ids' ref_field, built_at ref_at, question_id, 'label' kind, unnest(legacy_knw_ids) r from label_units
  union all select 'label_units', 'legacy_unmatched_ids', built_at, question_id, 'label', unnest(legacy_unmatched_ids) from label_units
  union all select 'label_units', 'parent_id', built_at, question_id, 'plan', parent_id from label_units where trim(parent_id, ' ' || chr(9)) is distinct from question_id
  union all select 'raw_question', 'parent_id', ingested_at, question_id, 'raw', parent_id from raw_question),
cutrefs as (select table_name, ref_field, ref_at, question_id, kind, trim(r, ' ' || chr(9)) ref_key from refs where trim(r, ' ' || chr(9)) <> ''),
targets as (
  select 'label' kind, label_id ref_key, added_at f, retired_at t from label_catalog
  union all select 'plan', question_id, created_at, deleted_at from parent_plan
  union all select 'raw', question_id, ingested_at, null from raw_question),
keys as (select kind, ref_key, bool_or(t is null) living from targets where ref_key is not null group by all),
numbered as (select *, row_number() over () rid from cutrefs),
met as (select n.*, k.living,
  exists (select 1 from targets x where x.kind = n.kind and x.ref_key = n.ref_key and (n.ref_at is null or ((x.f is null or x.f <= n.ref_at) and (x.t is null or n.ref_at < x.t)))) covered,
  not exists (select 1 from targets x where x.kind = n.kind and x.ref_key = n.ref_key and (x.t is null or x.t > n.ref_at)) over_ from numbered n left join keys k on n.kind = k.kind and n.ref_key = k.ref_key),
merged as (select *, case when living is null then 'missing' when living then case when covered then 'living' else 'late' end when not covered and over_ then 'stale' else 'deleted' end status from met)"""

QUERIES = {"p2_found": p2_found, "p2_status_by_month": p2_status_by_month}
ORACLES = {
    "p2_found": f"with {_REFS} select distinct table_name, ref_field, strftime(ref_at, '%Y-%m') period, question_id, ref_key from merged where status in ('missing', 'deleted', 'stale')",
    "p2_status_by_month": f"with {_REFS} select table_name, ref_field, strftime(ref_at, '%Y-%m') period, count(*) n_refs, count_if(status = 'missing')::bigint n_missing, count_if(status = 'deleted')::bigint n_deleted, count_if(status = 'stale')::bigint n_stale, count_if(status = 'late')::bigint n_late, count_if(status = 'living')::bigint n_living from merged group by all",
}
