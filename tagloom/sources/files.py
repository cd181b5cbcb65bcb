"""File sources: JSON lines (strict, lenient, counted, live), one giant JSON object, rule files, workbooks, JSON inside HTML.

Schemas are always given, never inferred, so ids stay strings."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BAD = "_corrupt_record"


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; a line that is no object of the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _with_bad(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"), "value")
    array = F.trim("value").startswith("{")
    return parsed.select("r.*", array.alias("_object")).withColumn(BAD, F.when(~F.col("_object") | F.col(BAD).isNotNull(), F.coalesce(F.col(BAD), F.lit("no object")))).drop("_object")


def lenient_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Malformed lines and lines that are no object are dropped."""
    return _with_bad(spark, path, schema).where(F.col(BAD).isNull()).drop(BAD)


def counted_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str, valid: str = "true") -> tuple[DataFrame, DataFrame]:
    """(latest row of each key among valid rows, one row with the numbers of malformed and of invalid rows)."""
    rows = _with_bad(spark, path, schema)
    good = rows.where(F.col(BAD).isNull() & F.expr(valid)).drop(BAD)
    cols = [c for c in good.columns if c != key]
    latest = good.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")
    counts = rows.agg(F.count_if(F.col(BAD).isNotNull()).alias("malformed"), F.count_if(F.col(BAD).isNull() & ~F.coalesce(F.expr(valid), F.lit(False))).alias("invalid"))
    return latest, counts


def log_health(log: DataFrame, key: str, error: str, ok: str) -> DataFrame:
    """One row on an append-only log: rows, malformed, without key, errors, invalid successes, repeated successes."""
    bad = F.col(BAD).isNotNull() if BAD in log.columns else F.lit(False)
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    success = ~bad & F.col(key).isNotNull() & ~failed & F.coalesce(F.expr(ok), F.lit(False))
    per = log.withColumn("_ok", success).withColumn("_bad", bad).withColumn("_failed", failed)
    n = per.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("_bad").alias("malformed"), F.count_if(~F.col("_bad") & F.col(key).isNull()).alias("without_key"), F.count_if(~F.col("_bad") & F.col("_failed")).alias("errors"),
        F.count_if(~F.col("_bad") & F.col(key).isNotNull() & ~F.col("_failed") & ~F.col("_ok")).alias("invalid"), F.count_if("_ok").alias("_s"), F.count_distinct(F.when(F.col("_ok"), F.col(key))).alias("keys"),
    )
    return n.withColumn("repeated", F.col("_s") - F.col("keys")).drop("_s")


def tail(log: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows of a log by its order column: a top-k, so no full sort."""
    return log.orderBy(F.desc(order)).limit(n)


def text_of(df: DataFrame, *names: str) -> DataFrame:
    """df with the first non-null of several historical columns as `value`; names that are no columns are skipped."""
    there = [F.col(n) for n in names if n in df.columns]
    return df.withColumn("value", F.coalesce(*there) if there else F.lit(None))


def rules(spark: SparkSession, path: str, actions: list[str]) -> DataFrame:
    """(question_id, label_id, action, reason) of a rule file {"rules": [...]}; unknown actions and repeated pairs are errors."""
    from tagloom.runtime import assert_empty

    r = spark.read.schema("rules array<struct<question_id:string,label_id:string,action:string,reason:string>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("rules"))
    assert_empty(r.where(~F.col("action").isin(actions) | F.col("question_id").isNull() | F.col("label_id").isNull()), "unknown action or missing id in a rule")
    assert_empty(r.groupBy("question_id", "label_id").count().where("count > 1"), "repeated rule")
    return r


def embedded_json(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of the JSON array that a page assigns to the script variable `name`."""
    page = spark.read.text(path, wholetext=True)
    found = F.regexp_extract("value", rf"(?s)\b{re.escape(name)}\s*=\s*(\[.*?\])\s*;", 1)
    return page.select(F.inline(F.from_json(F.replace(found, F.lit(r"<\/"), F.lit("</")), f"array<{schema}>")))


# --- one giant JSON object ---------------------------------------------------


def object_members(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(key, value as JSON) of a top-level object that arrives in chunks; only one member is held at a time.

    Raises on anything but one object, also behind its end."""
    decode, buffer, at, done = json.JSONDecoder().raw_decode, "", 0, False
    chunks = iter(chunks)

    def more() -> bool:
        nonlocal buffer, at
        piece = next(chunks, None)
        if piece is None:
            return False
        buffer, at = buffer[at:] + piece, 0
        return True

    def skip() -> str:
        nonlocal at
        while True:
            while at < len(buffer) and buffer[at] in " \t\r\n":
                at += 1
            if at < len(buffer):
                return buffer[at]
            if not more():
                return ""

    def value():
        nonlocal at
        while True:
            try:
                v, end = decode(buffer, at)
                if end < len(buffer) or isinstance(v, (str, dict, list)):
                    at = end
                    return v
            except ValueError:
                pass
            if not more():
                try:
                    v, at = decode(buffer, at)
                    return v
                except ValueError as e:
                    raise ValueError("unfinished JSON value") from e

    if skip() != "{":
        raise ValueError("no JSON object")
    at += 1
    first = True
    while not done:
        c = skip()
        if c == "}" :
            at, done = at + 1, True
            break
        if not first:
            if c != ",":
                raise ValueError("comma expected")
            at += 1
            skip()
        first = False
        key = value()
        if not isinstance(key, str) or skip() != ":":
            raise ValueError("member expected")
        at += 1
        skip()
        yield key, json.dumps(value(), ensure_ascii=False, sort_keys=True)
    if skip():
        raise ValueError("something behind the object")


class GiantObject(DataSource):
    """spark.read.format("giant_object").load(path): (key, value) rows of one huge JSON object a file. Option chunk: characters read at once."""

    @classmethod
    def name(cls) -> str:
        return "giant_object"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema):
        return _GiantReader(self.options["path"], int(self.options.get("chunk", 1 << 20)))


class _GiantReader(DataSourceReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            yield from object_members(iter(lambda: f.read(self.chunk), ""))


# --- workbooks ---------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def workbook_rows(path: str, sheet: int = 1) -> list[list[str]]:
    """The cells of one sheet of an .xlsx file as texts. For small reference tables; it runs on the driver."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str] = {}
            for n, c in enumerate(row.findall("m:c", _NS)):
                letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                col = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else n
                v = c.find("m:v", _NS)
                cells[col] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def taxonomy(spark: SparkSession, rows: list[list[str]], columns: dict[str, str], unique: list[str]) -> DataFrame:
    """A reference table from rows with a header. columns: header -> column; every value is required, `unique` columns may not repeat."""
    head = [h.strip() for h in rows[0]]
    if missing := [h for h in columns if h not in head]:
        raise ValueError(f"missing columns: {missing}")
    at = {name: head.index(h) for h, name in columns.items()}
    data = [{n: (r[k].strip() if k < len(r) else "") for n, k in at.items()} for r in rows[1:] if any(x.strip() for x in r)]
    for i, r in enumerate(data, 2):
        if blank := [n for n, v in r.items() if not v]:
            raise ValueError(f"row {i}: blank {blank}")
    for u in unique:
        if len({r[u] for r in data}) < len(data):
            raise ValueError(f"{u} is not unique")
    return spark.createDataFrame([tuple(r[n] for n in at) for r in data], T.StructType([T.StructField(n, T.StringType(), False) for n in at]))
