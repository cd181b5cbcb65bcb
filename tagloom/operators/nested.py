"""Deeply nested semi-structured records to flat tables that keep the parent-child links.

The JSON text is parsed once into a VARIANT. Each level is one higher-order projection: a transform over the containers
of the level above attaches the path, the parent's path and the place in it, flatten joins their children to one array. The nodes of all levels are
flattened into one array, and each target table (values, containers) is emitted by a single inline; a row's parent_path is the key of its container's row. Keys need not be known. The number of levels is the data's
own depth, found by one map-side aggregated pass; more than LEVELS levels are expanded in rounds, so no depth is cut.

Defined cases: null and blank texts give no row; a text that is a JSON string is replaced by it; a text that does not
start with { or [ is one value at `$`; invalid JSON (also with anything behind it) gives no row; nulls, blank strings and
empty containers are no values but count as positions; a repeated key counts with its last value; a value under an
excluded key is left out at any depth; numbers are values, not texts, so 46.0 is written 46; repeated input rows give repeated output rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import table

LEVELS = 8
BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: str | Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(c, BLANK, "")


def parsed(text: str) -> Column:
    """The whole text as VARIANT, null unless all of it is one JSON value.

    The parser itself stops after the first value; as a member of an object between fixed keys the text must be complete."""
    doc = f"try_parse_json(concat('{{\"v\":', {text}, ',\"end\":0}}'))"
    members = f"try_variant_get({doc}, '$', 'map<string,variant>')"
    return F.expr(f"case when map_contains_key({members}, 'end') and size({members}) = 2 then {members}['v'] end")


def _depth(text: str) -> Column:
    """The nesting depth of a JSON text, from its brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    step = lambda acc, ch: F.struct(
        (acc.now + F.when(ch.isin("[", "{"), 1).otherwise(-1)).alias("now"),
        F.greatest(acc.top, acc.now + F.when(ch.isin("[", "{"), 1).otherwise(-1)).alias("top"),
    )
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc.top)


def _children(nodes: str, skip: list[str]) -> str:
    """SQL: the children of all containers in the array column nodes, each with its path."""
    out = ", ".join(f"'{k}'" for k in skip) or "''"
    members = "map_entries(coalesce(try_variant_get(n.v, '$', 'map<string,variant>'), cast(map() as map<string,variant>)))"
    items = "coalesce(try_variant_get(n.v, '$', 'array<variant>'), cast(array() as array<variant>))"
    return (
        f"flatten(transform({nodes}, n -> concat("
        f"transform(filter({members}, e -> e.key not in ({out})), e -> named_struct('path', concat(n.path, '/', e.key), 'up', n.path, 'place', e.key, 'depth', n.depth + 1, 'v', e.value)), "
        f"transform({items}, (x, i) -> named_struct('path', concat(n.path, '/', i), 'up', n.path, 'place', cast(i as string), 'depth', n.depth + 1, 'v', x)))))"
    )


_SCALAR = "try_variant_get(n.v, '$', 'map<string,variant>') is null and try_variant_get(n.v, '$', 'array<variant>') is null and n.v is not null"


_OBJECT, _ARRAY = "try_variant_get(n.v, '$', 'map<string,variant>')", "try_variant_get(n.v, '$', 'array<variant>')"
_PLACE = "'parent_path', n.up, 'place', n.place, 'depth', n.depth"


def flatten_tables(df: DataFrame, text: str, keys: list[str], skip: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(values, containers) of the JSON column `text`, whatever its shape.

    values: (keys..., leaf_path, leaf_value, parent_path, place, depth), a row for each scalar; place is the key or array position in the container
    at parent_path, which is null for a text that is one value. containers: (keys..., node_path, kind, members, parent_path, place, depth), a row for each object
    and array, also empty ones. skip: object keys whose subtrees are left out."""
    spark = df.sparkSession
    raw = df.select(*keys, strip(text).alias("_t")).where("_t <> ''")
    as_string = parsed("_t").cast("string")
    raw = raw.withColumn("_t", F.when(F.col("_t").startswith('"'), F.coalesce(as_string, F.col("_t"))).otherwise(F.col("_t")))
    is_json = F.col("_t").startswith("{") | F.col("_t").startswith("[")
    none = F.lit(None).cast("string")
    plain = raw.where(~is_json & (strip("_t") != "")).select(*keys, F.lit("$").alias("leaf_path"), F.col("_t").alias("leaf_value"), none.alias("parent_path"), none.alias("place"), F.lit(0).alias("depth"))
    depth = raw.where(is_json).agg(F.max(_depth("_t")).alias("d")).first().d or 0
    was = spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        root = "array(named_struct('path', '$', 'up', cast(null as string), 'place', cast(null as string), 'depth', 0, 'v', _v))"
        nodes = raw.where(is_json).withColumn("_v", parsed("_t")).where("_v is not null").select(*keys, F.expr(root).alias("_n0"))
        parts, boxes, first = [plain], [], True
        while depth > 0 or first:
            levels = min(depth, LEVELS)
            for k in range(levels):
                nodes = nodes.withColumn(f"_n{k + 1}", F.expr(_children(f"_n{k}", list(skip))))
            below = [f"_n{k + 1}" for k in range(levels)]
            every = ", ".join(below) or "filter(_n0, n -> false)"
            leaves = nodes.select(*keys, F.expr(f"inline(transform(filter(concat({every}), n -> {_SCALAR}), n -> named_struct('leaf_path', n.path, 'leaf_value', try_variant_get(n.v, '$', 'string'), {_PLACE})))"))
            parts.append(leaves.where(strip("leaf_value") != ""))
            # The containers above the last level; those on it begin the next round.
            above = ", ".join(["_n0", *below][: max(1, levels)])
            boxes.append(nodes.select(*keys, F.expr(f"inline(transform(filter(concat({above}), n -> {_OBJECT} is not null or {_ARRAY} is not null), n -> named_struct('node_path', n.path, 'kind', if({_OBJECT} is not null, 'object', 'array'), 'members', cast(coalesce(size({_OBJECT}), size({_ARRAY})) as bigint), {_PLACE})))")))
            depth, first = depth - levels, False
            nodes = nodes.select(*keys, F.expr(f"filter(_n{levels}, n -> not ({_SCALAR}) and n.v is not null)").alias("_n0")).where("size(_n0) > 0")
        values, containers = reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, boxes)
        _ = values.schema, containers.schema  # analysed while the setting holds
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", was)
    return values, containers


def flatten_json(df: DataFrame, text: str, keys: list[str], skip: list[str] = ()) -> DataFrame:
    """(keys..., leaf_path, leaf_value): a row for each scalar of the JSON column `text`, whatever its shape."""
    return flatten_tables(df, text, keys, skip)[0].select(*keys, "leaf_path", "leaf_value")


def parent_links(plan: DataFrame, parent: str = "question_id", children: str = "child_question_ids") -> DataFrame:
    """(child_id, parent_question_id, child_no): distinct links of a parent table with an array of children; child_no is the first position."""
    rows = plan.select(F.col(parent).alias("parent_question_id"), F.posexplode(children).alias("child_no", "child_id")).where("child_id is not null and parent_question_id is not null")
    return rows.groupBy("child_id", "parent_question_id").agg(F.min("child_no").alias("child_no"))


#: Keys that hold no answer (fixed values).
NO_VALUE = ["blankId", "index", "no", "score"]


def answer_values(units: DataFrame, plan: DataFrame) -> DataFrame:
    """(parent_question_id, question_id, leaf_path, leaf_value) of label_units and parent_plan."""
    values = flatten_json(units, "answer", ["question_id"], NO_VALUE)
    links = parent_links(plan).select(F.col("child_id").alias("question_id"), "parent_question_id")
    return values.join(links, "question_id", "left").select(F.coalesce("parent_question_id", "question_id").alias("parent_question_id"), "question_id", "leaf_path", "leaf_value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return answer_values(table(spark, d, "label_units"), table(spark, d, "parent_plan")).select("parent_question_id", "question_id", "leaf_path").distinct()


def p5_children(spark: SparkSession, d: str) -> DataFrame:
    """The link table: every parent with its listed children and whether the child is there."""
    links = parent_links(table(spark, d, "parent_plan"))
    units = table(spark, d, "label_units").select(F.col("question_id").alias("child_id"), F.lit(True).alias("present")).distinct()
    return links.join(units, "child_id", "left").select("parent_question_id", "child_id", F.col("child_no").cast("bigint").alias("child_no"), F.coalesce("present", F.lit(False)).alias("present"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """The value table: every answer value with the key of its container and its place there."""
    values, _ = flatten_tables(table(spark, d, "label_units"), "answer", ["question_id"], NO_VALUE)
    return values.select("question_id", "leaf_path", "leaf_value", "parent_path", "place", "depth").distinct()


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container table: every object and array of an answer with its own container; members counts what the answer has, excluded keys too."""
    _, boxes = flatten_tables(table(spark, d, "label_units"), "answer", ["question_id"], NO_VALUE)
    return boxes.select("question_id", "node_path", "kind", "members", "parent_path", "place", "depth").distinct()


QUERIES = {"p5_found": p5_found, "p5_values": p5_values, "p5_containers": p5_containers, "p5_children": p5_children}
_TREE = r"""with raw as (select question_id, regexp_replace(answer, '^\s+|\s+$', '', 'g') a from label_units where regexp_replace(coalesce(answer, ''), '^\s+|\s+$', '', 'g') <> ''),
txt as (select question_id, case when a like '"%' and json_valid(a) then a::json ->> '$' else a end a from raw),
tree as (select question_id, '$' || regexp_replace(fullkey[2:], '\."([^"]*)"|\.([^.\[\]"]+)|\[(\d+)\]', '/\1\2\3', 'g') node_path, j."type" kind, j.atom ->> '$' leaf_value, j.value from (select question_id, a from txt where left(a, 1) in ('{', '[') and json_valid(a)) x, json_tree(x.a) j
  where not regexp_matches(fullkey, '\.(blankId|index|no|score)([.\[]|$)')),
placed as (select *, nullif(regexp_replace(node_path, '/[^/]*$', ''), node_path) parent_path, case when node_path <> '$' then regexp_extract(node_path, '[^/]*$') end place, (len(node_path) - len(replace(node_path, '/', '')))::int depth from tree),
leaf as (select question_id, '$' leaf_path, a leaf_value, null parent_path, null place, 0 depth from txt where left(a, 1) not in ('{', '[') and trim(a) <> ''
  union all select question_id, node_path, case when kind = 'DOUBLE' then rtrim(rtrim(leaf_value, '0'), '.') else leaf_value end, parent_path, place, depth from placed where kind not in ('OBJECT', 'ARRAY', 'NULL') and not (kind = 'VARCHAR' and regexp_matches(leaf_value, '^\s*$'))),
links as (select distinct child question_id, parent_question_id from (select question_id parent_question_id, unnest(child_question_ids) child from parent_plan) where child is not null)"""
ORACLES = {
    "p5_found": f"{_TREE} select distinct coalesce(parent_question_id, l.question_id) parent_question_id, l.question_id, leaf_path from leaf l left join links k on k.question_id = l.question_id",
    "p5_values": f"{_TREE} select distinct question_id, leaf_path, leaf_value, parent_path, place, depth from leaf",
    "p5_containers": f"{_TREE} select distinct question_id, node_path, lower(kind) kind, case kind when 'ARRAY' then json_array_length(value) else len(json_keys(value)) end::bigint members, parent_path, place, depth from placed where kind in ('OBJECT', 'ARRAY')",
    "p5_children": """with l as (select question_id parent_question_id, unnest(child_question_ids) child_id, generate_subscripts(child_question_ids, 1) - 1 child_no from parent_plan),
g as (select parent_question_id, child_id, min(child_no)::bigint child_no from l where child_id is not null and parent_question_id is not null group by all)
select parent_question_id, child_id, child_no, exists (select 1 from label_units u where u.question_id = child_id) present from g""",
}
