"""Repair of grouped questions, record by record: units built from raw questions, orphan parents looked up in their source, contexts reconnected,
filtered groups with restored and wrapped rows, and streams united with their collisions aside.

Every operator returns rows with the action that was taken; counts are aggregates over them. All joins are by key; a parent with very many children
is joined in salted parts and never collected into one row.

Defined cases: blank and null parent ids name the question itself; a source row with broken JSON has no text; of several rows of one id the first arrival
counts; a null id is no row; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import corpus as C
from tagloom.runtime import salted_join, table

#: What an orphan parent's source row may hold.
STATUSES = ["missing_from_original", "found_nonself_parent_row", "found_with_text_stem", "found_with_other_text", "found_image_only_stem", "found_without_text"]
RECOVERABLE, WRAPPED = STATUSES[2:4], STATUSES[4:]


def own_parent(parent: str = "parent_id", key: str = "question_id") -> Column:
    """The id of a question's parent, its own where it has none."""
    p = F.btrim(F.col(parent), F.lit(" \t"))
    return F.when(p.isNull() | (p == ""), F.col(key)).otherwise(p)


def material(raw: DataFrame) -> DataFrame:
    """(question_id, parent_id, stem, options, analysis, image, ingested_at): each question's first arrival with its texts normalized; image: its stem shows one."""
    first = C.first_rows(raw.select("question_id", "parent_id", "question_info", "ingested_at"), "question_id", ["ingested_at"])
    read = first.withColumn("_i", F.from_json("question_info", C.INFO, {"mode": "PERMISSIVE"}))
    options = F.transform("_i.options", lambda o: F.struct(X.html_normalize(o["title"]).alias("title"), X.html_normalize(o["htmlCode"]).alias("htmlCode")))
    image = F.contains(F.lower(X.text("_i.stem")), F.lit("<img"))
    return read.select("question_id", own_parent().alias("parent_id"), X.html_normalize("_i.stem").alias("stem"), X.options_text(options).alias("options"), X.html_normalize("_i.analysis").alias("analysis"), image.alias("image"), "ingested_at")


def orphan_source(wanted: DataFrame, source: DataFrame) -> DataFrame:
    """(parent_id, children, status, parent_stem): wanted (parent_id, children) looked up in the source (of material)."""
    s = source.select(F.col("question_id").alias("parent_id"), F.col("parent_id").alias("_up"), "stem", "options", "analysis", "image")
    status = (
        F.when(F.col("_up").isNull(), STATUSES[0])
        .when(F.col("_up") != F.col("parent_id"), STATUSES[1])
        .when(F.col("stem") != "", STATUSES[2])
        .when((F.col("options") != "") | (F.col("analysis") != ""), STATUSES[3])
        .when(F.col("image"), STATUSES[4])
        .otherwise(STATUSES[5])
    )
    return wanted.join(s, "parent_id", "left").select("parent_id", "children", status.alias("status"), X.text("stem").alias("parent_stem"))


def repaired_context(units: DataFrame, plan: DataFrame, audit: DataFrame) -> DataFrame:
    """(question_id, parent_id, parent_stem, action): units that name a parent, with the context that they get.

    kept: they have one; reconnected: a living plan row has the text; recovered: the orphan's source has text (its stem, also if blank); wrapped: the parent is
    there without text; dropped: there is no parent to be had, so the row goes to the side. plan: (parent_id, plan_stem); audit: of orphan_source."""
    u = units.select("question_id", own_parent().alias("parent_id"), "parent_stem").where("parent_id <> question_id")
    j = salted_join(salted_join(u, plan, ["parent_id"], "left"), audit.select("parent_id", "status", F.col("parent_stem").alias("_source")), ["parent_id"], "left")
    blank = lambda c: F.trim(X.text(c)) == ""
    action = (
        F.when(~blank("parent_stem"), "kept")
        .when(~blank("plan_stem"), "reconnected")
        .when(F.col("plan_stem").isNotNull(), "wrapped")
        .when(F.col("status").isin(RECOVERABLE), "recovered")
        .when(F.col("status").isin(WRAPPED), "wrapped")
        .otherwise("dropped")
    )
    stem = F.when(action == "kept", F.col("parent_stem")).when(action == "reconnected", F.col("plan_stem")).when(action == "recovered", X.text("_source")).otherwise(F.lit(""))
    return j.select("question_id", "parent_id", stem.alias("parent_stem"), action.alias("action"))


def filtered(merged: DataFrame, allowed: DataFrame, originals: DataFrame) -> DataFrame:
    """(question_id, parent_id, body, action) of merged questions cut down to the allowed ids.

    kept: as merged; restored: an update had replaced it, so the original's body comes back; wrapper: a parent that isn't allowed stays as an empty row
    around its allowed children; removed: neither. merged and originals: (question_id, parent_id, body); allowed: (question_id)."""
    a = allowed.select("question_id").distinct().withColumn("_in", F.lit(True))
    j = merged.join(a, "question_id", "left").join(originals.select("question_id", F.col("parent_id").alias("_p"), F.col("body").alias("_b")), "question_id", "left")
    inside = F.coalesce("_in", F.lit(False))
    changed = F.col("_b").isNotNull() & (F.col("_b") != F.col("body"))
    rows = j.select("question_id", F.when(inside & changed, F.col("_p")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(inside & changed, F.col("_b")).when(inside, F.col("body")).otherwise("").alias("body"), F.when(inside & changed, "restored").when(inside, "kept").otherwise("removed").alias("action"))
    held = rows.where("action <> 'removed' and parent_id <> question_id").select(F.col("parent_id").alias("question_id")).distinct()
    wrappers = held.join(a, "question_id", "left_anti").select("question_id", F.col("question_id").alias("parent_id"), F.lit("").alias("body"), F.lit("wrapper").alias("action"))
    return rows.join(wrappers.select("question_id"), "question_id", "left_anti").unionByName(wrappers)


def built_units(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, plan) of raw questions (of material), whatever arrived first.

    units: (question_id, parent_id, unit_type, parent_stem, siblings); unit_type is standalone, sub_question, or orphan_sub_question where the parent never
    arrived; siblings counts the parent's other children. plan: (question_id, parent_stem, children, synthetic_parent), a row for each question
    with children and, synthetic, for each parent that never arrived."""
    kids = source.where("parent_id <> question_id")
    sizes = kids.groupBy(F.col("parent_id").alias("question_id")).agg(F.count(F.lit(1)).alias("children"))
    stems = source.select("question_id", F.col("stem").alias("parent_stem"))
    plan = sizes.join(stems.withColumn("_there", F.lit(True)), "question_id", "left").select("question_id", X.text("parent_stem").alias("parent_stem"), "children", F.col("_there").isNull().alias("synthetic_parent"))
    alone = source.where("parent_id = question_id").join(sizes.select("question_id"), "question_id", "left_anti")
    of_parent = plan.withColumnRenamed("question_id", "parent_id")
    sub = salted_join(kids.select("question_id", "parent_id"), of_parent, ["parent_id"])
    kind = F.when(F.col("synthetic_parent"), "orphan_sub_question").otherwise("sub_question")
    units = alone.select("question_id", "parent_id", F.lit("standalone").alias("unit_type"), F.lit("").alias("parent_stem"), F.lit(0).cast("bigint").alias("siblings"))
    return units.unionByName(sub.select("question_id", "parent_id", kind.alias("unit_type"), "parent_stem", (F.col("children") - 1).alias("siblings"))), plan


def united(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of both with `side`: stream, or collision where the key stands in both (those of the second go to the side table)."""
    both = first.select(key).distinct().withColumn("_both", F.lit(True))
    hit = second.join(both, key, "left").withColumn("side", F.when(F.col("_both"), "collision").otherwise("stream")).drop("_both")
    return first.withColumn("side", F.lit("stream")).unionByName(hit)


# --- queries ----------------------------------------------------------------------


def _wanted(s: SparkSession, d: str) -> DataFrame:
    """Parents that units name and that are no living plan row."""
    living = table(s, d, "parent_plan").where("deleted_at is null").select(F.col("question_id").alias("parent_id")).distinct()
    refs = table(s, d, "label_units").select("question_id", own_parent().alias("parent_id")).where("parent_id <> question_id").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    return refs.join(living, "parent_id", "left_anti")


def _audit(s, d):
    return orphan_source(_wanted(s, d), material(table(s, d, "raw_question")))


def q_audit(s: SparkSession, d: str) -> DataFrame:
    return _audit(s, d)


def q_audit_report(s, d):
    return _audit(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("parents"), F.sum("children").alias("children"))


def q_repaired(s, d):
    plan = table(s, d, "parent_plan").where("deleted_at is null").groupBy(F.col("question_id").alias("parent_id")).agg(F.max(X.text("parent_stem")).alias("plan_stem"))
    return repaired_context(table(s, d, "label_units"), plan, _audit(s, d))


def q_filtered(s, d):
    """Raw questions with their last arrivals merged over the first, cut down to the questions that became units."""
    raw = table(s, d, "raw_question").where("question_id is not null").select("question_id", own_parent().alias("parent_id"), F.md5(X.text("question_info")).alias("body"), "ingested_at")
    one = lambda f: raw.groupBy("question_id").agg(f(F.struct("parent_id", "body"), F.struct("ingested_at", "body")).alias("r")).select("question_id", "r.*")
    return filtered(one(F.max_by), table(s, d, "label_units"), one(F.min_by))


def q_built_units(s, d):
    return built_units(material(table(s, d, "raw_question")))[0]


def q_built_plan(s, d):
    return built_units(material(table(s, d, "raw_question")))[1]


def q_united(s, d):
    """Children units and parents' materials as one stream, a row each."""
    u = table(s, d, "label_units").select("question_id", "unit_type")
    p = table(s, d, "parent_plan").where("deleted_at is null and trim(coalesce(parent_stem, '')) <> ''").select("question_id").distinct().withColumn("unit_type", F.lit("composite_parent_extra"))
    return united(u, p, "question_id")


_OWN = "case when coalesce(trim(parent_id, ' ' || chr(9)), '') = '' then question_id else trim(parent_id, ' ' || chr(9)) end"
_J = "(case when json_valid(i) then i::json end)"
_MATERIAL = f"""f as (select question_id, arg_min(struct_pack(p := parent_id, i := question_info), ingested_at) r from raw_question where question_id is not null group by 1),
fi as (select question_id, r.p parent_id, r.i i from f), fo as (select question_id, {_OWN} parent_id, {_J} j from fi),
op as (select question_id, unnest(from_json(j, '{{"options":[{{"title":"VARCHAR","htmlCode":"VARCHAR"}}]}}').options) o from fo),
oq as (select distinct question_id from op where {C._sql_text('o.title')} <> '' and {C._sql_text('o.htmlCode')} <> ''),
m as (select question_id, parent_id, {C._sql_text("j ->> '$.stem'")} stem, question_id in (select question_id from oq) opt, {C._sql_text("j ->> '$.analysis'")} analysis, lower(coalesce(j ->> '$.stem', '')) like '%<img%' image from fo)"""
_AUDIT = f"""{_MATERIAL}, living as (select distinct question_id from parent_plan where deleted_at is null),
w as (select pid parent_id, count(*) children from (select question_id, {_OWN} pid from label_units) where pid <> question_id and pid not in (select question_id from living) group by 1),
au as (select w.parent_id, children, case when m.question_id is null then 'missing_from_original' when m.parent_id <> w.parent_id then 'found_nonself_parent_row' when stem <> '' then 'found_with_text_stem' when opt or analysis <> '' then 'found_with_other_text' when image then 'found_image_only_stem' else 'found_without_text' end status, coalesce(stem, '') parent_stem from w left join m on m.question_id = w.parent_id)"""
_BUILT = f"""{_MATERIAL}, k as (select parent_id, count(*) children from m where parent_id <> question_id group by 1),
pl as (select k.parent_id question_id, coalesce(m.stem, '') parent_stem, children, m.question_id is null synthetic_parent from k left join m on m.question_id = k.parent_id)"""
QUERIES = {"orphan_source_audit": q_audit, "orphan_source_report": q_audit_report, "repaired_context": q_repaired, "filtered_questions": q_filtered, "built_units": q_built_units, "built_plan": q_built_plan, "united_stream": q_united}
ORACLES = {
    "orphan_source_audit": f"with {_AUDIT} select * from au",
    "orphan_source_report": f"with {_AUDIT} select status, count(*) parents, sum(children)::bigint children from au group by 1",
    "repaired_context": f"""with {_AUDIT}, ps as (select question_id parent_id, max(coalesce(parent_stem, '')) plan_stem from parent_plan where deleted_at is null group by 1),
u as (select question_id, {_OWN} parent_id, parent_stem from label_units), j as (select u.question_id, u.parent_id, u.parent_stem own, plan_stem, status, au.parent_stem src from u left join ps on ps.parent_id = u.parent_id left join au on au.parent_id = u.parent_id where u.parent_id <> u.question_id),
a as (select *, case when trim(coalesce(own, ''), ' ') <> '' then 'kept' when trim(coalesce(plan_stem, ''), ' ') <> '' then 'reconnected' when plan_stem is not null then 'wrapped' when status in ('found_with_text_stem', 'found_with_other_text') then 'recovered' when status in ('found_image_only_stem', 'found_without_text') then 'wrapped' else 'dropped' end "action" from j)
select question_id, parent_id, case "action" when 'kept' then own when 'reconnected' then plan_stem when 'recovered' then src else '' end parent_stem, "action" from a""",
    "filtered_questions": f"""with r as (select question_id, {_OWN} parent_id, md5(coalesce(question_info, '')) body, ingested_at from raw_question where question_id is not null),
l as (select question_id, arg_max(parent_id, (ingested_at, body)) lp, arg_max(body, (ingested_at, body)) lb, arg_min(parent_id, (ingested_at, body)) fp, arg_min(body, (ingested_at, body)) fb from r group by 1),
x as (select question_id, case when ins and lb <> fb then fp else lp end parent_id, case when ins then fb else '' end body, case when ins and lb <> fb then 'restored' when ins then 'kept' else 'removed' end "action" from (select *, question_id in (select question_id from label_units) ins from l)),
w as (select distinct parent_id q from x where "action" <> 'removed' and parent_id <> question_id and parent_id not in (select question_id from label_units))
select * from x where question_id not in (select q from w) union all select q, q, '', 'wrapper' from w""",
    "built_units": f"with {_BUILT} select question_id, parent_id, 'standalone' unit_type, '' parent_stem, 0::bigint siblings from m where parent_id = question_id and question_id not in (select parent_id from k) union all select m.question_id, m.parent_id, case when synthetic_parent then 'orphan_sub_question' else 'sub_question' end, pl.parent_stem, children - 1 from m join pl on pl.question_id = m.parent_id where m.parent_id <> m.question_id",
    "built_plan": f"with {_BUILT} select * from pl",
    "united_stream": "select question_id, unit_type, 'stream' side from label_units union all select question_id, 'composite_parent_extra', case when question_id in (select question_id from label_units) then 'collision' else 'stream' end from (select distinct question_id from parent_plan where deleted_at is null and trim(coalesce(parent_stem, ''), ' ') <> '')",
}
