"""Corpus preparation: cleaning, grouping of parents and children in any order of arrival, units, exact duplicates, merges, orphan audits.

Order of arrival is a column (ingested_at and a hash for ties), never the order of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators.nested import parsed
from tagloom.runtime import HOT_KEYS, salted_join, table

INFO = "struct<stem:string,analysis:string,answer:string,options:array<struct<title:string,htmlCode:string>>>"


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; `copies` counts the key's rows. Aggregation with map-side combining, not a window."""
    cols = [c for c in df.columns if c != key]
    tie = F.xxhash64(*[F.col(c).cast("string") for c in cols if df.schema[c].dataType.simpleString() in ("string", "int", "double", "timestamp_ntz", "timestamp", "bigint")])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order, tie)).alias("_r"), F.count(F.lit(1)).alias("copies")).select(key, "_r.*", "copies")


def clean(raw: DataFrame) -> DataFrame:
    """raw_question with its JSON parsed and each text field normalized; `error` where the JSON is broken."""
    info = F.from_json("question_info", INFO, {"mode": "PERMISSIVE"})
    valid = parsed("question_info")
    empty = F.trim(X.text("question_info")) == ""
    read = raw.withColumn("error", F.when(~empty & valid.isNull(), F.lit("question_info is no JSON object"))).withColumn("_i", F.when(F.col("error").isNull(), info))
    return read.select("question_id", "parent_id", X.html_normalize("_i.stem").alias("stem"), X.html_normalize("_i.analysis").alias("analysis"), "_i.answer", F.col("_i.options").alias("options"), "subject", "ingested_at", "error")


def clean_options(raw: DataFrame) -> DataFrame:
    """(question_id, options): the options of each row's first arrival as lines, normalized."""
    first = first_rows(raw.select("question_id", "question_info", "ingested_at"), "question_id", ["ingested_at"])
    o = first.select("question_id", F.posexplode(F.from_json("question_info", INFO)["options"]).alias("n", "o"))
    o = o.select("question_id", "n", X.html_normalize("o.title").alias("t"), X.html_normalize("o.htmlCode").alias("h")).where("t <> '' and h <> ''")
    return o.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("t", F.lit(". "), "h").alias("x")))), lambda s: s["x"]), "\n").alias("options"))


def group_parents(raw: DataFrame) -> DataFrame:
    """(question_id, role, placeholder, children, n_children, copies): every parent with its children, whatever arrived first; a parent that
    never arrived is a placeholder. A row whose parent is itself or null is a parent."""
    one = first_rows(raw.select("question_id", F.btrim("parent_id", F.lit(" \t")).alias("parent_id"), "ingested_at"), "question_id", ["ingested_at"])
    own = F.col("parent_id").isNull() | (F.col("parent_id") == "") | (F.col("parent_id") == F.col("question_id"))
    kids = one.where(~own).groupBy(F.col("parent_id").alias("question_id")).agg(F.array_join(F.array_sort(F.collect_list("question_id")), "|").alias("children"), F.count(F.lit(1)).alias("n_children"))
    roots = one.where(own).select("question_id", "copies", F.lit(False).alias("child"))
    nested = one.where(~own).select("question_id", "copies", F.lit(True).alias("child"))
    j = roots.unionByName(nested.join(kids.select("question_id"), "question_id", "left_semi")).join(kids, "question_id", "full")
    return j.select("question_id", F.col("child").isNull().alias("placeholder"), F.coalesce("children", F.lit("")).alias("children"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("copies", F.lit(0)).alias("copies"))


def hashed_units(units: DataFrame, label_array: str = "legacy_knw_ids") -> DataFrame:
    """(question_id, content_hash, sig): the hash of a unit's content, and its labels as one text."""
    h = X.content_hash(*[F.regexp_replace(F.trim(X.text(f)), r"\s+", " ") for f in ("parent_stem", "stem", "options", "answer_text", "analysis")])
    sig = F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col(label_array), F.array().cast("array<string>")))), ",")
    return units.select("question_id", h.alias("content_hash"), sig.alias("sig"))


def dedupe_groups(units: DataFrame) -> DataFrame:
    """(content_hash, primary_id, n_members, label_sets, conflict): units of equal content; the first id is the primary."""
    g = hashed_units(units).groupBy("content_hash").agg(F.min("question_id").alias("primary_id"), F.count(F.lit(1)).alias("n_members"), F.count_distinct("sig").alias("label_sets"))
    return g.where("n_members > 1").withColumn("conflict", F.col("label_sets") > 1)


def dedupe_members(units: DataFrame) -> DataFrame:
    """(question_id, primary_id, conflict): the members of all groups, a row each, however many a group has."""
    groups = dedupe_groups(units)
    hot = groups.orderBy(F.desc("n_members")).limit(HOT_KEYS)
    return salted_join(hashed_units(units).select("question_id", "content_hash"), groups, ["content_hash"], hot=hot).select("question_id", "primary_id", "conflict")


def route(unit_type: str, matched: str, unmatched: str) -> Column:
    """R0, R1 or R2 for a unit by its numbers of matched and unmatched labels."""
    return (
        F.when(F.col(matched) == 0, "R2")
        .when(F.col(unmatched) > 0, "R2")
        .when(F.col(unit_type) == "sub_question", "R1")
        .when(F.col(matched) > 1, "R1")
        .otherwise("R0")
    )


def merge(base: DataFrame, updates: DataFrame, key: str, at: str) -> DataFrame:
    """base with the latest update of each key put over it and new keys appended; `action` says which. Base duplicates stay."""
    cols = [c for c in base.columns if c != key]
    latest = updates.groupBy(key).agg(F.max_by(F.struct(*cols), at).alias("_u"))
    j = base.select(key, F.struct(*cols).alias("_b")).join(latest, key, "full")
    action = F.when(F.col("_b").isNull(), "added").when(F.col("_u").isNull(), "kept").otherwise("replaced")
    return j.select(key, F.coalesce("_u", "_b").alias("_r"), action.alias("action")).select(key, "_r.*", "action")


# --- queries ----------------------------------------------------------------------


def _u(s, d):
    return table(s, d, "label_units")


def q_clean_report(s: SparkSession, d: str) -> DataFrame:
    c = clean(table(s, d, "raw_question"))
    return c.groupBy("subject").agg(F.count(F.lit(1)).alias("n_rows"), F.count("error").alias("errors"), F.count_if(F.col("error").isNull() & (F.col("stem") == "")).alias("blank_stems"))


def q_html(s, d):
    return clean(table(s, d, "raw_question")).where("error is null").select("question_id", "ingested_at", "stem", "analysis")


def q_options(s, d):
    return clean_options(table(s, d, "raw_question"))


def q_answers(s, d):
    return _u(s, d).select("question_id", X.answer_text(F.col("answer")).alias("rendered"))


def q_groups(s, d):
    return group_parents(table(s, d, "raw_question"))


def q_duplicates(s, d):
    r = table(s, d, "raw_question")
    return r.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("question_info").alias("forms")).where("n_rows > 1")


def q_dedupe(s, d):
    return dedupe_groups(_u(s, d))


def q_dedupe_savings(s, d):
    return dedupe_groups(_u(s, d)).agg(F.count(F.lit(1)).alias("groups"), F.sum("n_members").alias("members"), F.sum(F.col("n_members") - 1).alias("saved"), F.count_if("conflict").alias("conflicts"))


def _routed(s, d):
    catalog = table(s, d, "label_catalog").select("label_id", F.lit(1).alias("hit"))
    ids = _u(s, d).select("question_id", "unit_type", F.explode_outer("legacy_knw_ids").alias("r")).select("question_id", "unit_type", F.trim("r").alias("label_id"))
    n = ids.join(catalog, "label_id", "left").groupBy("question_id", "unit_type").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull() & (X.text("label_id") != "")).alias("unmatched"))
    return n.withColumn("route", route("unit_type", "matched", "unmatched"))


def q_route(s, d):
    return _routed(s, d)


def q_dup_flags(s, d):
    """Write-back: each unit with its duplicate's primary and the route it takes (a copy follows its primary)."""
    m = dedupe_members(_u(s, d))
    j = _routed(s, d).join(m, "question_id", "left")
    dup = F.when(F.col("primary_id") != F.col("question_id"), F.col("primary_id"))
    return j.select("question_id", dup.alias("duplicate_of"), F.coalesce("conflict", F.lit(False)).alias("conflict"), F.when(dup.isNotNull(), "copy").when(F.col("conflict"), "R2").otherwise(F.col("route")).alias("route"))


def q_status(s, d):
    u = _u(s, d)
    st = X.content_status("stem", "parent_stem", "options", "answer_text", "analysis")
    img = X.mentions_image("parent_stem", "stem", "options")
    return u.groupBy("unit_type", st.alias("status"), img.alias("mentions_image"), F.col("flags.image_context_missing").alias("image_missing")).agg(F.count(F.lit(1)).alias("n"))


def q_explode(s, d):
    """Units from parents: each listed child with its position and number of siblings, and whether the unit is there."""
    p = table(s, d, "parent_plan").where("deleted_at is null").select(F.col("question_id").alias("parent_id"), F.posexplode_outer("child_question_ids").alias("pos", "question_id"), F.size(F.array_distinct("child_question_ids")).cast("bigint").alias("siblings"))
    there = _u(s, d).select("question_id", F.lit(True).alias("present"))
    return p.join(there, "question_id", "left").select("parent_id", "question_id", F.col("pos").cast("bigint").alias("pos"), F.when(F.col("siblings") >= 0, F.col("siblings")).alias("siblings"), F.coalesce("present", F.lit(False)).alias("present")).distinct()


def q_orphans(s, d):
    """Referenced parents that are no living plan row, by status and with the number of units and of units with a blank stem."""
    plan = table(s, d, "parent_plan").groupBy(F.col("question_id").alias("parent_id")).agg(F.count_if(F.col("deleted_at").isNull()).alias("living"))
    refs = _u(s, d).where("trim(parent_id) <> '' and trim(parent_id) <> question_id").groupBy(F.trim("parent_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.trim(X.text("stem")) == "").alias("blank_children"))
    j = refs.join(plan, "parent_id", "left").where("coalesce(living, 0) = 0")
    return j.select("parent_id", F.when(F.col("living").isNull(), "absent").otherwise("deleted").alias("status"), "children", "blank_children")


def q_orphan_status(s, d):
    return q_orphans(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("parents"), F.sum("children").alias("children"))


def q_repair(s, d):
    """Units with a parent reference by what can be done: context there, to be reconnected from the plan, or orphaned."""
    stems = table(s, d, "parent_plan").where("deleted_at is null").groupBy(F.col("question_id").alias("pid")).agg(F.max("parent_stem").alias("plan_stem"))
    u = _u(s, d).where("trim(parent_id) <> '' and trim(parent_id) <> question_id").withColumn("pid", F.trim("parent_id"))
    act = F.when(F.trim(X.text("parent_stem")) != "", "has_context").when(F.trim(X.text("plan_stem")) != "", "reconnect").when(F.col("plan_stem").isNotNull(), "parent_without_text").otherwise("orphan")
    return u.join(stems, "pid", "left").groupBy("unit_type", act.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def q_merge(s, d):
    """Later arrivals as updates over first ones of one subject: the last update wins, new keys are appended."""
    r = table(s, d, "raw_question").where("subject = '高中生物'")
    base = first_rows(r.select("question_id", "difficulty", "ingested_at"), "question_id", ["ingested_at"]).drop("copies")
    return merge(base.select("question_id", "difficulty"), r.where("difficulty is not null").select("question_id", "difficulty", "ingested_at"), "question_id", "ingested_at").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def q_membership(s, d):
    """Units restricted to questions that were voted on, with the ones left out counted by type."""
    voted = table(s, d, "vote_responses").select("question_id").distinct()
    inside = _u(s, d).join(voted, "question_id", "left_semi").groupBy("unit_type").agg(F.count(F.lit(1)).alias("n")).withColumn("inside", F.lit(True))
    outside = _u(s, d).join(voted, "question_id", "left_anti").groupBy("unit_type").agg(F.count(F.lit(1)).alias("n")).withColumn("inside", F.lit(False))
    return inside.unionByName(outside)


def q_union(s, d):
    """Children units and parent-material units as one stream; ids in both are collisions and go to the side table."""
    u = _u(s, d).select("question_id", F.col("unit_type"))
    p = table(s, d, "parent_plan").where("deleted_at is null and trim(coalesce(parent_stem, '')) <> ''").select("question_id").distinct().withColumn("unit_type", F.lit("composite_parent_extra"))
    both = u.unionByName(p)
    n = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    return both.withColumn("collides", n > 1).groupBy("unit_type", "collides").agg(F.count(F.lit(1)).alias("n"))


def q_catalog_quality(s, d):
    c = table(s, d, "label_catalog")
    blank = lambda x: F.count_if(F.trim(X.text(x)) == "").alias(f"blank_{x}")
    return c.groupBy("label_type").agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("label_name").alias("names"), F.count_distinct("label_path").alias("paths"), blank("definition"), blank("core_concepts"), blank("common_assessments"), blank("distinctions"), F.count("retired_at").alias("retired"))


def q_catalog_dups(s, d):
    """Uniqueness constraints of the catalogue: values of id, name or path that occur more than once."""
    c = table(s, d, "label_catalog")
    e = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in ("label_id", "label_name", "label_path")])).alias("e")).select("e.*")
    return e.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def q_modules(s, d):
    c = table(s, d, "label_catalog")
    return c.groupBy(F.element_at(F.split("label_path", "->"), 1).alias("top"), X.path_module("label_path").alias("module")).agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("label_name").rlike("综合|其他")).alias("catch_all"))


def q_siblings(s, d):
    """Pairs of labels under one parent of the taxonomy."""
    c = table(s, d, "label_catalog").select("label_id", X.path_parent("label_path").alias("parent"))
    o = c.select(F.col("label_id").alias("sibling_id"), "parent")
    return c.join(o, "parent").where("label_id <> sibling_id")


def q_hash(s, d):
    """Content hashes of units, and an order-insensitive fingerprint of the table (sum of row hashes)."""
    h = X.content_hash("parent_stem", "stem", "options", "answer_text", "analysis")
    return _u(s, d).select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("forms"), F.min("h").alias("least"), F.max("h").alias("most"))


def _sql_text(x: str) -> str:
    """SQL of what a field of question HTML becomes; of character references only those that the test tables have."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in "，。；：？！")
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide).replace("'", "''")
    sub = lambda s, rules: reduce(lambda a, r: f"regexp_replace({a}, '{r[0]}', '{r[1]}', 'g')", rules, s)
    out = sub(f"coalesce({x}, '')", [(r"(?i)(?:\$\s*)*<img[^>]*>(?:\s*<br\s*/?>)*", " "), (r"(?i)</sup>\s*<sup>", ""), (r"(?i)</sub>\s*<sub>", ""), (r"(?is)<sup>\s*(.*?)\s*</sup>", r"^{\1}"), (r"(?is)<sub>\s*(.*?)\s*</sub>", r"_{\1}")])
    out = f"replace({out}, '$(\\qquad)$', '(   )')"
    out = sub(out, [(r"(?is)<span\s+class=[\"''][^\"'']*underline[^\"'']*fillblank[^\"'']*[\"''][^>]*>.*?</span>", "______"), (r"(?s)<!--.*?-->", ""), (r"(?s)</?[A-Za-z][^>]*>", " ")])
    out = f"replace(replace(replace(replace({out}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    out = sub(out, [(r"(?:\$\s*)+", " "), (r"\s*(?:\\!\s*)*%\s*(?:\\!\s*)*(?:\\text\{\s*\})?", r"\\%")])
    out = f"translate({out}, '{wide}', '{narrow}')"
    for old, new in (("﹣", "-"), ("−", "-"), ("～", "~"), ("≥", ">="), ("≤", "<="), ("≠", "!="), ("\u3000", " "), ("\u00a0", " ")):
        out = f"replace({out}, '{old}', '{new}')"
    out = f"replace(trim(regexp_replace({out}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}]+', ' ', 'g'), ' '), '()', '(   )')"
    return "trim(" + sub(out, [(r"\s+([。，！？；：\"''）】])", r"\1")]) + ", ' ')"


_INFO = """q as (select *, trim(coalesce(question_info, ''), ' ') = '' bare, case when json_valid(question_info) then question_info::json end j from raw_question)"""
_FIRST = "f as (select question_id, arg_min(parent_id, ingested_at) parent_id, count(*) copies from (select question_id, trim(parent_id, ' ' || chr(9)) parent_id, ingested_at from raw_question) group by 1)"
_SQ = "regexp_replace(trim(coalesce({}, '')), '\\s+', ' ', 'g')"
_DG = f"""h as (select question_id, sha256(to_json([{', '.join(_SQ.format(x) for x in ('parent_stem', 'stem', 'options', 'answer_text', 'analysis'))}])::varchar) h, array_to_string(list_sort(list_distinct(coalesce(legacy_knw_ids, []))), ',') || (case when list_contains(coalesce(legacy_knw_ids, []), null) then ',' else '' end) sig from label_units),
dg as (select h, min(question_id) primary_id, list(question_id) members, count(*) n_members, count(distinct sig) label_sets, count(distinct sig) > 1 conflict from h group by h having count(*) > 1)"""
_ROUTE = """rt as (select question_id, unit_type, count(c.label_id) matched, coalesce(count_if(c.label_id is null and coalesce(r, '') <> ''), 0)::bigint unmatched from (select question_id, unit_type, unnest(case when len(legacy_knw_ids) > 0 then legacy_knw_ids else [null] end) r0, trim(r0, ' ') r from label_units) u left join label_catalog c on c.label_id = r group by all),
routed as (select *, case when matched = 0 or unmatched > 0 then 'R2' when unit_type = 'sub_question' or matched > 1 then 'R1' else 'R0' end route from rt)"""
_ORPH = """orph as (select p.parent_id, case when l.living is null then 'absent' else 'deleted' end status, children, blank_children from (select trim(parent_id, ' ') parent_id, count(*) children, count_if(trim(coalesce(stem, ''), ' ') = '')::bigint blank_children from label_units where trim(parent_id, ' ') <> '' and trim(parent_id, ' ') <> question_id group by 1) p
left join (select question_id, count_if(deleted_at is null) living from parent_plan group by 1) l on l.question_id = p.parent_id where coalesce(living, 0) = 0)"""

QUERIES = {
    "clean_report": q_clean_report, "html_normalize": q_html, "clean_options": q_options, "answer_render": q_answers, "parent_group": q_groups, "duplicate_ids": q_duplicates, "exact_dup_groups": q_dedupe, "dup_savings": q_dedupe_savings,
    "unit_route": q_route, "dup_flags": q_dup_flags, "content_status": q_status, "parent_explode": q_explode, "orphan_parents": q_orphans, "orphan_status": q_orphan_status, "context_repair": q_repair, "merge_updates": q_merge,
    "membership_filter": q_membership, "unit_union": q_union, "catalog_quality": q_catalog_quality, "catalog_uniqueness": q_catalog_dups, "module_rollup": q_modules, "sibling_pairs": q_siblings, "content_hashes": q_hash,
}
ORACLES = {
    "html_normalize": f"with {_INFO} select question_id, ingested_at, {_sql_text("j ->> '$.stem'")} stem, {_sql_text("j ->> '$.analysis'")} analysis from q where bare or j is not null",
    "clean_report": f"with {_INFO} select subject, count(*) n_rows, (count(*) filter (where not bare and j is null))::bigint errors, (count(*) filter (where (bare or j is not null) and {_sql_text("j ->> '$.stem'")} = ''))::bigint blank_stems from q group by 1",
    "clean_options": f"""with f as (select question_id, arg_min(question_info, ingested_at) i from raw_question where question_id is not null group by 1), e as (select question_id, unnest(from_json(case when json_valid(i) then i end, '{{"options":[{{"title":"VARCHAR","htmlCode":"VARCHAR"}}]}}').options) o, generate_subscripts(from_json(case when json_valid(i) then i end, '{{"options":[{{"title":"VARCHAR","htmlCode":"VARCHAR"}}]}}').options, 1) n from f),
c as (select question_id, n, {_sql_text('o.title')} t, {_sql_text('o.htmlCode')} h from e) select question_id, string_agg(t || '. ' || h, chr(10) order by n) options from c where t <> '' and h <> '' group by 1""",
    "parent_group": f"with {_FIRST}, k as (select parent_id question_id, array_to_string(list_sort(list(question_id)), '|') children, count(*) n_children from f where coalesce(parent_id, '') not in ('', question_id) group by 1), r as (select question_id, copies from f where coalesce(parent_id, '') in ('', question_id) or question_id in (select question_id from k)) select coalesce(r.question_id, k.question_id) question_id, r.question_id is null placeholder, coalesce(children, '') children, coalesce(n_children, 0) n_children, coalesce(copies, 0) copies from r full join k on r.question_id = k.question_id",
    "duplicate_ids": "select question_id, count(*) n_rows, count(distinct question_info) forms from raw_question group by 1 having count(*) > 1",
    "exact_dup_groups": f"with {_DG} select h content_hash, primary_id, n_members, label_sets, conflict from dg",
    "dup_savings": f"with {_DG} select count(*) \"groups\", sum(n_members)::bigint members, sum(n_members - 1)::bigint saved, count_if(conflict)::bigint conflicts from dg",
    "unit_route": f"with {_ROUTE} select * from routed",
    "dup_flags": f"with {_DG}, {_ROUTE}, m as (select primary_id, conflict, unnest(members) question_id from dg) select r.question_id, case when primary_id <> r.question_id then primary_id end duplicate_of, coalesce(conflict, false) conflict, case when primary_id <> r.question_id then 'copy' when conflict then 'R2' else route end route from routed r left join m on m.question_id = r.question_id",
    "content_status": "select unit_type, case when trim(coalesce(stem, ''), ' ') <> '' then 'stem' when trim(coalesce(parent_stem, ''), ' ') || trim(coalesce(options, ''), ' ') || trim(coalesce(answer_text, ''), ' ') || trim(coalesce(analysis, ''), ' ') <> '' then 'other_text' else 'none' end status, regexp_matches(concat_ws(chr(10), parent_stem, stem, options), '" + "|".join(X.IMAGE_WORDS) + "') mentions_image, flags.image_context_missing image_missing, count(*) n from label_units group by all",
    "parent_explode": "select distinct p.question_id parent_id, e.q question_id, e.pos pos, (len(list_distinct(child_question_ids)) + (len(list_filter(child_question_ids, lambda x: x is null)) > 0)::int)::bigint siblings, exists (select 1 from label_units u where u.question_id = e.q) present from parent_plan p left join lateral (select unnest(p.child_question_ids) q, unnest(range(len(p.child_question_ids))) pos) e on true where deleted_at is null",
    "orphan_parents": f"with {_ORPH} select * from orph",
    "orphan_status": f"with {_ORPH} select status, count(*) parents, sum(children)::bigint children from orph group by 1",
    "context_repair": "select unit_type, case when trim(coalesce(u.parent_stem, ''), ' ') <> '' then 'has_context' when trim(coalesce(ps, ''), ' ') <> '' then 'reconnect' when ps is not null then 'parent_without_text' else 'orphan' end \"action\", count(*) n from label_units u left join (select question_id pid, max(parent_stem) ps from parent_plan where deleted_at is null group by 1) p on trim(u.parent_id, ' ') = pid where trim(parent_id, ' ') <> '' and trim(parent_id, ' ') <> question_id group by all",
    "merge_updates": "with r as (select * from raw_question where subject = '高中生物'), b as (select distinct question_id from r), u as (select distinct question_id from r where difficulty is not null) select case when b.question_id is null then 'added' when u.question_id is null then 'kept' else 'replaced' end \"action\", count(*) n from b full join u on b.question_id = u.question_id group by 1",
    "membership_filter": "select unit_type, count(*) n, question_id in (select question_id from vote_responses) inside from label_units group by all",
    "unit_union": "with b as (select question_id, unit_type from label_units union all select distinct question_id, 'composite_parent_extra' from parent_plan where deleted_at is null and trim(coalesce(parent_stem, ''), ' ') <> ''), c as (select *, count(*) over (partition by question_id) > 1 collides from b) select unit_type, collides, count(*) n from c group by all",
    "catalog_quality": "select label_type, count(*) labels, count(distinct label_name) names, count(distinct label_path) paths, " + ", ".join(f"count_if(trim(coalesce({x}, ''), ' ') = '')::bigint blank_{x}" for x in ("definition", "core_concepts", "common_assessments", "distinctions")) + ", count(retired_at) retired from label_catalog group by all",
    "catalog_uniqueness": "select field, \"value\", count(*) n from (select unnest(['label_id', 'label_name', 'label_path']) field, unnest([label_id, label_name, label_path]) \"value\" from label_catalog) group by all having count(*) > 1",
    "module_rollup": "select string_split(label_path, '->')[1] top, coalesce(string_split(label_path, '->')[2], 'missing') module, count(*) labels, count_if(regexp_matches(label_name, '综合|其他'))::bigint catch_all from label_catalog group by all",
    "sibling_pairs": "with c as (select label_id, array_to_string(list_slice(string_split(label_path, '->'), 1, -2), '->') parent from label_catalog) select a.label_id, b.label_id sibling_id, a.parent from c a join c b on a.parent = b.parent and a.label_id <> b.label_id",
    "content_hashes": "select count(*) n_rows, count(distinct h) forms, min(h) least, max(h) most from (select sha256(to_json([coalesce(parent_stem, ''), coalesce(stem, ''), coalesce(options, ''), coalesce(answer_text, ''), coalesce(analysis, '')])::varchar) h from label_units)",
}
