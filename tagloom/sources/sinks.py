"""Sinks: published folders, shards with a manifest, one file per label, workbooks, Markdown and HTML reports."""

from __future__ import annotations

import html
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import assert_empty


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, fmt: str = "json", check=None, partition: list[str] = ()) -> None:
    """Write to a private sibling folder, run check(written DataFrame), and rename once it passes. An existing target is an error."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path}.{uuid.uuid4().hex}.stage"
    try:
        df.write.partitionBy(*partition).format(fmt).save(stage)
        if check:
            check(spark.read.schema(df.schema).format(fmt).load(stage))
        if fs.exists(target) or not fs.rename(_fs(spark, stage)[1], target):
            raise FileExistsError(path)
    finally:
        fs.delete(_fs(spark, stage)[1], True)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with its keys in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def append(df: DataFrame, path: str) -> None:
    """Append evidence; a failed job leaves nothing half-written behind (files are committed by the job)."""
    df.write.mode("append").parquet(path)


def fingerprint(df: DataFrame) -> str:
    """An order-insensitive fingerprint of a table's rows and columns."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)])
    r = df.select(h.alias("h"), F.xxhash64(h, F.lit(1)).alias("g")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))).first()
    return ":".join(str(x or 0) for x in r)


def write_shards(df: DataFrame, path: str, key: str, shards: int, config: dict) -> dict:
    """df in `shards` folders by hash of the key, with a manifest that holds each one's count and fingerprint and the run's config."""
    parts = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    publish(parts, path, "parquet", partition=["shard"])
    n = {r.shard: r["n"] for r in parts.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"shards": shards, "key": key, "counts": {str(k): n.get(k, 0) for k in range(shards)}, "config": config, "fingerprint": fingerprint(df)}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}.manifest")
    return manifest


def merge_shards(spark: SparkSession, source: str, results: DataFrame, key: str, config: dict) -> DataFrame:
    """results, if they cover the shards written by write_shards exactly and the config is the same; else an error."""
    manifest = json.loads(spark.read.text(f"{source}.manifest").first().value)
    if manifest["config"] != config:
        raise ValueError("the run's config differs from the manifest's")
    units = spark.read.parquet(source)
    if fingerprint(units.drop("shard")) != manifest["fingerprint"]:
        raise ValueError("the shards have changed since they were written")
    assert_empty(units.join(results, key, "left_anti").select(key), "missing result")
    assert_empty(results.join(units, key, "left_anti").select(key), "result of an unknown key")
    assert_empty(results.groupBy(key).count().where("count > 1"), "repeated result")
    return results


def per_label(scores: DataFrame, path: str) -> None:
    """One folder of JSON a label, its rows by score and then id, and an index of labels with counts."""
    ordered = scores.repartition("label_id").sortWithinPartitions("label_id", F.desc("score"), "question_id")
    publish(ordered, path, "json", partition=["label_id"])
    publish(scores.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).coalesce(1), f"{path}.index", "json")


def workbook(sheets: dict[str, list[list]], path: str) -> None:
    """An .xlsx file of small tables (rows of cells, the first a header)."""
    def cell(v) -> str:
        if isinstance(v, bool) or v is None or not isinstance(v, (int, float)):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape("" if v is None else str(v), quote=False)}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{html.escape(s)}" sheetId="{k}" r:id="s{k}"/>' for k, s in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="s{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        for k, rows in zip(n, sheets.values()):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown; more than `most` rows are an error, since a report is for readers."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", "<br>")
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(text, r)) + " |" for r in rows), ""])


def page(df: DataFrame, title: str, most: int = 5000) -> str:
    """A standalone HTML page with the rows as embedded JSON; `</` is escaped."""
    rows = [r.value for r in json_lines(df).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    data = "[" + ",".join(rows).replace("</", "<\\/") + "]"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table id=t></table><script>const DATA = {data};\nfor (const r of DATA) t.insertRow().append(...Object.values(r).map(v => Object.assign(document.createElement('td'), {{textContent: v}})))</script>"
