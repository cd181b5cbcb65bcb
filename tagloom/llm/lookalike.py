"""Visually identical text with different characters.

Skeleton of a text: compatibility decomposition, invisible characters removed, every character replaced by its prototype
(Latin letter for a Greek or Cyrillic one of the same shape, a plain blank for any other blank), decomposition again. Rows are
grouped by the 128-bit hash of their fields' skeletons; pairs are made between groups of equal originals, so a third of all rows
being one text are one class until ids are expanded.

Letter case, punctuation, the number of blanks and line breaks stay as they are.

Defined cases: null equals empty; a pair of rows with the same characters is no pair; repeated rows of one id never pair with themselves;
unassigned and private characters stand for themselves; an empty table gives no row; texts are used whole."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import HOT_KEYS, salted_join, spread, table, written

# Greek and Cyrillic letters and the Latin letters of the same shape. The rule: a letter whose Unicode prototype (the confusables table, see
# tests) is a basic Latin letter, of the same case, unless its upright form is another one than the Latin letter's.
GREEK = "ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϺ" "οϲϳ"
GREEK_AS = "JABEZHIKMNOPTYXFCM" "ocj"
CYRILLIC = "АВЕЅІЈКМНОРСТУХԌԚԜҮӀ" "аеорсухѕіјһԁԛԝүӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXGQWYI" "aeopcyxsijhdqwyl"
#: Letters with such a prototype that are told apart by their upright form, and used as themselves in texts about the sciences.
LEFT_OUT = "ͺαγινρσυϒϱ" "ЬгѡѵѴҽ"
# Characters without a visible form that are not of the format class.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Controls that break a line or tabulate are visible.
VISIBLE_CONTROLS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"

PROTOTYPE = str.maketrans(GREEK + CYRILLIC, GREEK_AS + CYRILLIC_AS)


#: Planes that have format and control characters: the basic one, the first supplementary one up to its notations, and the tags.
RANGES = (range(0x1E000), range(0xE0000, 0xE0200))


def _special() -> tuple[re.Pattern, re.Pattern]:
    """Characters that a skeleton drops, and blanks that it makes plain, as one class each."""
    drop, blanks = [], []
    for c in (chr(x) for r in RANGES for x in r):
        kind = unicodedata.category(c)
        if kind in ("Cf", "Cc") and c not in VISIBLE_CONTROLS or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or c in INVISIBLE:
            drop.append(c)
        elif kind == "Zs":
            blanks.append(c)
    one = lambda cs: re.compile("[" + "".join(map(re.escape, cs)) + "]")
    return one(drop), one(["\t", *blanks])


def skeleton_function():
    """text -> skeleton; its tables are built where it is called."""
    drop, blank = _special()
    proto, nfkd = dict(PROTOTYPE), unicodedata.normalize

    def skeleton(text: str | None) -> str:
        if not text:
            return ""
        if text.isascii() and text.isprintable():
            return text
        return nfkd("NFKD", blank.sub(" ", drop.sub("", nfkd("NFKD", text)).translate(proto)))

    return skeleton


def _hashed(n: int):
    """Mapper (id, field1..n) -> (id, skel, orig): 128-bit hashes of all fields' skeletons and of their characters."""

    def key(parts: list[str]) -> bytes:
        return hashlib.md5("".join(f"{len(p)}:{p}" for p in parts).encode("utf-8", "surrogatepass")).digest()

    def run(batches):
        skeleton = skeleton_function()
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns[1:])))
            skel = [key([skeleton(x) for x in r]) for r in rows]
            orig = [key([x or "" for x in r]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(skel, pa.binary()), pa.array(orig, pa.binary())], ["id", "skel", "orig"])

    return run


def hashed(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    kind = df.schema[row_id].dataType.simpleString()
    return df.select(F.col(row_id).alias("id"), *fields).where("id is not null").transform(spread).mapInArrow(_hashed(len(fields)), f"id {kind}, skel binary, orig binary")


def _hot(classes: DataFrame) -> DataFrame:
    """(skel, orig): the largest groups of rows with the same characters, HOT_KEYS at most."""
    return classes.where("n > 1").orderBy(F.desc("n"), "skel", "orig").limit(HOT_KEYS).select("skel", "orig")


def look_classes(rows: DataFrame) -> DataFrame:
    """(skel, orig, n): a row for each different original among rows (id, skel, orig), with its number of rows."""
    return rows.groupBy("skel", "orig").agg(F.count(F.lit(1)).alias("n"))


def lookalike_pairs(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose fields all look the same while a character differs.

    Pairs of different originals are made first, and a large group of equal originals is expanded in salted parts on whichever side it stands."""
    rows = written(hashed(df, row_id, fields).distinct(), "skeletons")  # ids and hashes only; the Python function runs once
    classes = look_classes(rows)
    mixed = classes.groupBy("skel").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("skel")
    forms = written(salted_join(classes, mixed, ["skel"], "left_semi"), "forms")
    hot = _hot(forms)
    side = lambda s: forms.select("skel", F.col("orig").alias(f"o{s}"))
    pairs = salted_join(side("a"), side("b"), ["skel"]).where("oa <> ob")
    named = lambda s: hot.select("skel", F.col("orig").alias(f"o{s}"))
    own = lambda s: rows.select("skel", F.col("orig").alias(f"o{s}"), F.col("id").alias(f"id_{s}"))
    left = salted_join(own("a"), pairs, ["skel", "oa"], hot=named("a"))
    both = salted_join(left, own("b"), ["skel", "ob"], hot=named("b"))
    return both.where("id_a < id_b").select("id_a", "id_b")


def lookalike_groups(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(id, group_id, class_id, forms, rows), a row for each id: the smallest id that looks the same, the smallest with the same characters, and how many
    different originals and rows the group has. No pair is made."""
    rows = written(hashed(df, row_id, fields).distinct(), "skeletons")
    classes = rows.groupBy("skel", "orig").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    group = classes.groupBy("skel").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("forms"), F.sum("n").alias("rows"))
    known = salted_join(classes.select("skel", "orig", "class_id"), group, ["skel"])
    out = salted_join(rows, known, ["skel", "orig"])
    return out.groupBy("id").agg(F.min(F.struct("group_id", "class_id", "forms", "rows")).alias("g")).select("id", "g.*")


def one_form(df: DataFrame, fields: list[str], form: str = "NFC") -> DataFrame:
    """df with each field in one consistent form: its skeleton, composed again."""

    def apply(batches):
        skeleton = skeleton_function()
        for b in batches:
            cols = [pa.array([None if x is None else unicodedata.normalize(form, skeleton(x)) for x in b.column(k).to_pylist()], pa.string()) if name in fields else b.column(k) for k, name in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(apply, df.schema)


FIELDS = ["stem", "options", "answer_text"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike_pairs(table(spark, d, "exchange_units"), "exchange_id", FIELDS)
    return pairs.select(F.col("id_a").alias("exchange_id_a"), F.col("id_b").alias("exchange_id_b")).distinct()


def p7_one_form(spark: SparkSession, d: str) -> DataFrame:
    return one_form(table(spark, d, "exchange_units").select("exchange_id", *FIELDS), FIELDS)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the group of rows that look like it."""
    return lookalike_groups(table(spark, d, "exchange_units"), "exchange_id", FIELDS).withColumnRenamed("id", "exchange_id")


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups, "p7_one_form": p7_one_form}
ORACLES: dict[str, str] = {}
