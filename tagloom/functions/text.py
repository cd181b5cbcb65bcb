"""Text, hash and set functions as Column expressions; an Arrow UDF where SQL has no form (recursive answers)."""

from __future__ import annotations

import html
import html.entities
import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = str | Column


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: C) -> Column:
    """Null counts as empty."""
    return F.coalesce(_c(x), F.lit(""))


# --- HTML ---------------------------------------------------------------------

# Patterns of question HTML and what takes their place, in the order in which they apply: before entities are decoded, after it, and at the end.
MARKUP = [
    (r"(?i)(?:\$\s*)*<img[^>]*>(?:\s*<br\s*/?>)*", " "),
    (r"(?i)</(su[pb])>\s*<\1>", ""),
    (r"(?is)<sup>\s*(.*?)\s*</sup>", r"^{$1}"),
    (r"(?is)<sub>\s*(.*?)\s*</sub>", r"_{$1}"),
    (r"\$\(\\qquad\)\$", "(   )"),
    (r"""(?is)<span\s+class=["'][^"']*underline[^"']*fillblank[^"']*["'][^>]*>.*?</span>""", "______"),
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)</?[A-Za-z][^>]*>", " "),
]
MATH = [(r"(?:\$\s*)+", " "), (r"\s*(?:\\!\s*)*%\s*(?:\\!\s*)*(?:\\text\{\s*\})?", r"\\%")]
SPACES = [(r"(?U)\s+", " "), (r"^ | $", ""), (r"\(\)", "(   )"), (r"""\s+(?=[。，！？；："'）】])""", ""), (r"^ +| +$", "")]
# Full-width marks that stay, and characters with a plain form.
KEEP_WIDE = "，。；：？！"
PLAIN = {"﹣": "-", "−": "-", "～": "~", "≥": ">=", "≤": "<=", "≠": "!=", "\u3000": " ", "\u00a0": " "}


# Named references come from the standard library's table; those without a semicolon may also begin a longer run of letters.
# A lookup goes through them in order, so the most used ones come first.
_OFTEN = [f"{n};" for n in "nbsp lt gt amp quot apos ldquo rdquo lsquo rsquo mdash ndash hellip times deg middot alpha beta gamma ensp emsp".split()]
_NAMED = {n: html.entities.html5[n] for n in [*_OFTEN, *html.entities.html5]}
_BARE = sorted((n for n in _NAMED if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numeric references below this number are looked up, since some stand for another character or for none.
_LOW = 256


def unescape(x: C) -> Column:
    """Character references decoded as html.unescape does it, inside the JVM; a text without & is left alone."""
    # One literal each, so that the plan stays small.
    table_of = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,string>")
    named, low = table_of(_NAMED), table_of({str(n): html.unescape(f"&#{n};") for n in range(_LOW)})
    number = lambda digits, base: F.conv(F.when(F.length(digits) > 9, F.lit("7fffffff" if base == 16 else "2147483647")).otherwise(digits), base, 10).cast("bigint")
    digits = lambda s: F.regexp_replace(F.regexp_replace(s, "^#[xX]?|;$", ""), "^0+(?=.)", "")

    def char(n: Column) -> Column:
        gone = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        none = n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        return F.when(gone, F.lit("\ufffd")).when(none, F.lit("")).when(n < _LOW, F.try_element_at(low, n.cast("string"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(part: Column) -> Column:
        s = F.substring(part, 2, 40)
        bare = F.regexp_extract(s, "^(" + "|".join(_BARE) + ")", 1)
        word = F.coalesce(F.try_element_at(named, s), F.when(bare != "", F.concat(F.try_element_at(named, bare), F.substring(s, F.length(bare) + 1, F.lit(40)))), part)
        return F.when(~F.startswith(part, F.lit("&")), part).when(s.rlike("^#[xX]"), char(number(digits(s), 16))).when(s.rlike("^#"), char(number(digits(s), 10))).otherwise(word)

    parts = lambda t: F.regexp_extract_all(t, F.lit(r"(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&)"), F.lit(1))
    whole = lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(parts(t), one), "")).otherwise(t)
    return F.element_at(F.transform(F.array(text(x)), whole), 1)  # bound to a variable, so that what makes the text is evaluated once


def html_normalize(x: C) -> Column:
    """Question text from HTML: images to blanks, sup/sub to ^{} and _{}, fill-in spans to ______, tags dropped, entities decoded, $ dropped,
    % escaped, full-width ASCII narrowed except marks of Chinese text, white space collapsed. Null gives an empty text."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = [(w, chr(ord(w) - 0xFEE0)) for w in wide if w not in KEEP_WIDE]
    sub = lambda c, rules: reduce(lambda a, r: F.regexp_replace(a, r[0], r[1]), rules, c)
    out = sub(unescape(sub(text(x), MARKUP)), MATH)
    out = F.translate(out, "".join(w for w, _ in narrow), "".join(n for _, n in narrow))
    for old, new in PLAIN.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return sub(out, SPACES)


def options_text(options: C) -> Column:
    """array<struct(title, htmlCode)> to lines `T. content`; entries without title or content are left out."""
    one = F.transform(_c(options), lambda o: F.struct(o["title"].alias("t"), o["htmlCode"].alias("h")))
    full = F.filter(one, lambda o: (F.trim(text(o["t"])) != "") & (F.trim(text(o["h"])) != ""))
    return text(F.array_join(F.transform(full, lambda o: F.concat(F.trim(o["t"]), F.lit(". "), F.trim(o["h"]))), "\n"))


# --- answers --------------------------------------------------------------------


def render_answer(value) -> str:
    """Readable text of an answer of any shape: blanks numbered by their index, lists joined by ；, true/false in Chinese, keys sorted."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "是" if value else "否"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, str):
        return re.sub(r"\s+", " ", value).strip()
    if isinstance(value, dict):
        if "answers" in value:
            return render_answer(value["answers"])
        parts = ((k, render_answer(value[k])) for k in sorted(value))
        return "；".join(f"{k}：{v}" for k, v in parts if v)
    blanks = value and all(isinstance(v, dict) and "answers" in v for v in value)
    if not blanks:
        return "；".join(v for v in map(render_answer, value) if v)
    place = [v.get("index") if isinstance(v.get("index"), int) else k for k, v in enumerate(value)]
    ordered = [v for _, _, v in sorted(zip(place, range(len(value)), value), key=lambda x: x[:2])]
    numbered = ((n, render_answer(v["answers"])) for n, v in enumerate(ordered, 1))
    return "；".join(f"空{n}：{v.replace('；', ' / ')}" for n, v in numbered if v)


@F.arrow_udf(T.StringType())
def answer_text(raw: pa.Array) -> pa.Array:
    """render_answer of a JSON text (or of a bare value); broken JSON gives null."""

    def one(x):
        x = (x or "").strip()
        if not x:
            return ""
        try:
            value = json.loads(x) if x[0] in '"[{' else x
            return render_answer(json.loads(value) if isinstance(value, str) and value[:1] in ("[", "{") else value)
        except ValueError:
            return None

    return pa.array([one(x) for x in raw.to_pylist()], pa.string())


# --- tokens ---------------------------------------------------------------------

# What a token and a run of Chinese characters is, and the longest run that is a token itself.
ASCII_TOKEN, CJK_RUN, WHOLE_RUN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*", r"[㐀-䶿一-鿿]+", 12


def tokens(x: C) -> Column:
    """ASCII terms, then of every CJK run its bigrams, trigrams and, up to WHOLE_RUN characters, itself; repeated tokens stay."""
    low = F.lower(text(x))
    grams = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: r.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    runs = F.transform(
        F.regexp_extract_all(low, F.lit(f"({CJK_RUN})"), F.lit(1)),
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(grams(r, 2), grams(r, 3), F.when(F.length(r) <= WHOLE_RUN, F.array(r)).otherwise(F.array().cast("array<string>")))),
    )
    return F.concat(F.regexp_extract_all(low, F.lit(f"({ASCII_TOKEN})"), F.lit(1)), F.flatten(runs))


def head_tail(x: C, n: int) -> Column:
    """The first third and the last two thirds of n characters with a mark between, if the text is longer."""
    t, head = text(x), max(1, n // 3)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(head)), F.lit("…[中间省略]…"), F.right(t, F.lit(max(1, n - head))))).otherwise(t)


def path_text(x: C) -> Column:
    return F.replace(text(x), F.lit("->"), F.lit("@"))


def path_parent(x: C) -> Column:
    """The path without its last segment; empty for a top segment."""
    return F.when(F.contains(_c(x), F.lit("->")), F.regexp_replace(_c(x), r"->(?:(?!->).)*$", "")).otherwise(F.lit(""))


def path_module(x: C) -> Column:
    """The second segment of a path, or `missing`."""
    return F.coalesce(F.try_element_at(F.split(_c(x), "->"), F.lit(2)), F.lit("missing"))


def safe_name(x: C) -> Column:
    """A text as part of a file name."""
    return F.substring(F.regexp_replace(F.trim(text(x)), r'[\\/:*?"<>|\s]+', "_"), 1, 80)


# --- hashes ---------------------------------------------------------------------


def content_hash(*fields: C) -> Column:
    """sha256 of the JSON array of the fields."""
    return F.sha2(F.to_json(F.array(*[text(f) for f in fields])), 256)


def hash_rank(seed: str, *keys: C, sep: str = "\0") -> Column:
    """A reproducible order of keys: sha256 of seed and keys as a hexadecimal string, which sorts as its bytes."""
    parts = [F.lit(seed)]
    for k in keys:
        parts += [F.lit(sep), _c(k).cast("string")]
    return F.sha2(F.concat(*parts), 256)


# --- sets -----------------------------------------------------------------------


def distinct_text(x: C) -> Column:
    """Trimmed non-empty strings of an array, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(_c(x), F.trim), lambda v: v.isNotNull() & (v != "")))


def jaccard(a: C, b: C) -> Column:
    """1 for two empty sets."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def relationship(old: C, new: C) -> Column:
    """How new stands to old; an empty new is a subset."""
    o, n = _c(old), _c(new)
    only_old, only_new = F.size(F.array_except(o, n)), F.size(F.array_except(n, o))
    return (
        F.when((only_old == 0) & (only_new == 0), "exact_match")
        .when(only_old == 0, "contains_all_legacy")
        .when(only_new == 0, "subset_of_legacy")
        .when(F.arrays_overlap(o, n), "mixed")
        .otherwise("disjoint")
    )


def change(a: C, b: C) -> Column:
    """From a to b: same, both_empty, more, fewer or replaced, the last with the change in number."""
    a, b = _c(a), _c(b)
    lost, won = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "both_empty")
        .when((lost == 0) & (won == 0), "same")
        .when(lost == 0, "more")
        .when(won == 0, "fewer")
        .when(won > lost, "replaced_more")
        .when(won < lost, "replaced_fewer")
        .otherwise("replaced")
    )


# --- bands ----------------------------------------------------------------------


def bands(x: C, edges: list[tuple[float, str]], top: str, zero: str | None = None, missing: str | None = None, closed: bool = False) -> Column:
    """The first name whose edge x is below (or equal to, if closed); `zero` for 0, `missing` for null."""
    x = _c(x)
    out = F.when(x.isNull(), missing)
    if zero:
        out = out.when(x == 0, zero)
    for edge, name in edges:
        out = out.when(x <= edge if closed else x < edge, name)
    return out.otherwise(top)


#: The score bands, sample tiers, rank bands and tiers of false acceptance.
SCORE = ([(0.40, "weak_related"), (0.70, "gray"), (0.80, "borderline_match")], "high_match", "zero")
SCORE_TENTHS = ([(k / 10, f"{(k - 1) / 10:.1f}-{k / 10:.1f}") for k in range(1, 9)], "0.8-1.0", None)
SAMPLE = ([(30, "LT1"), (100, "LT2"), (300, "LT3"), (500, "ADEQUATE")], "CAPPED", None)
FALSE_ACCEPT = ([(0.05, "low"), (0.15, "moderate"), (0.30, "high")], "very_high", None)


def score_band(x: C) -> Column:
    return bands(x, *SCORE)


def sample_tier(x: C) -> Column:
    return bands(x, *SAMPLE)


def false_accept_tier(x: C) -> Column:
    return bands(x, *FALSE_ACCEPT, closed=True)


def rank_band(x: C) -> Column:
    x = _c(x)
    return F.when(x.isNull() | (x < 1), "unknown").when(x <= 5, "1-5").when(x <= 10, "6-10").when(x <= 25, "11-25").otherwise("26+")


def logistic_of(true_logprob: C, false_logprob: C, floor: float = -10.0) -> Column:
    """The probability of `true` from two log-probabilities; a missing one counts as the floor."""
    t, f = F.coalesce(_c(true_logprob), F.lit(floor)), F.coalesce(_c(false_logprob), F.lit(floor))
    return 1 / (1 + F.exp(f - t))


# --- rules ----------------------------------------------------------------------

#: Words that point at a figure.
IMAGE_WORDS = "如图 图中 下图 上图 图示 示意图 曲线 坐标图 柱状图 图甲 图乙".split()


def mentions_image(*fields: C) -> Column:
    return F.concat_ws("\n", *[text(f) for f in fields]).rlike("|".join(IMAGE_WORDS))


def content_status(stem: C, *others: C) -> Column:
    rest = F.concat(*[F.trim(text(o)) for o in others])
    return F.when(F.trim(text(stem)) != "", "stem").when(rest != "", "other_text").otherwise("none")


def alignment_class(score: C, taxonomy_issue: C, needs_definition: C) -> Column:
    """L3 for a low score (up to 3) or a problem of the taxonomy, L2 where a name needs its definition, else L1."""
    return F.when((_c(score) <= 3) | _c(taxonomy_issue), "L3").when(_c(needs_definition), "L2").otherwise("L1")


def prefixes(limits: dict[str, int]) -> list[Column]:
    """Fields cut to their first characters."""
    return [F.left(text(c), F.lit(n)).alias(c) for c, n in limits.items()]


def without_prefix(df, prefix: str, nested: dict[str, list[str]] | None = None):
    """df without its columns of a prefix, and without the named fields of struct columns."""
    out = df.drop(*[c for c in df.columns if c.startswith(prefix)])
    for column, fields in (nested or {}).items():
        out = out.withColumn(column, F.col(column).dropFields(*fields))
    return out


def parse_condition(spec: str) -> dict:
    """`name:temperature:choices:workers[:seed]` as a dict."""
    parts = spec.split(":")
    if len(parts) not in (4, 5) or not parts[0]:
        raise ValueError(f"condition must be name:temperature:choices:workers[:seed]: {spec!r}")
    out = {"name": parts[0], "temperature": float(parts[1]), "choices": int(parts[2]), "workers": int(parts[3]), "seed": int(parts[4]) if len(parts) == 5 else None}
    if out["choices"] < 1 or out["workers"] < 1:
        raise ValueError(f"choices and workers must be positive: {spec!r}")
    return out
