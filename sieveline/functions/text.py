"""Text, path, format, hash and JSON functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("json", T.StringType())]))
# The words of a verdict.
FAKE_WORDS = ("fake", "ai-generated", "ai generated", "synthetic", "manipulated", "tampered", "tamper", "deepfake", "ai")
REAL_WORDS = ("real", "authentic", "natural", "genuine")
# Patterns whose matches count for fake and for real.
FAKE_PATTERNS = (
    r"\bai[-\s]?generated\b", r"\bsynthetic\b", r"\bdeepfake\b", r"\bfake\b", r"\bmanipulated\b", r"\btampered\b", r"\bcomposited\b", r"\bnot real\b",
    r"\bnot genuine\b", r"\bnot authentic\b",
)
REAL_PATTERNS = (r"\bgenuine\b", r"\bauthentic\b", r"\breal\b", r"\bunmanipulated\b", r"\bnot fake\b", r"\bnot ai[-\s]?generated\b", r"\bnot synthetic\b")
LATE = 0.7
# Extensions and their media types.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif"}


def normalize_verdict(c: Column) -> Column:
    """fake, real or uncertain for a free verdict; anything unknown or null is uncertain."""
    v = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", " ")
    v = F.trim(F.regexp_replace(F.regexp_replace(v, r"[^a-z0-9\-\s]", ""), r"\s+", " "))
    return F.when(v.isin(*FAKE_WORDS), "fake").when(v.isin(*REAL_WORDS), "real").otherwise("uncertain")


def final_verdict(parsed: Column, analysis: Column) -> Column:
    """The parsed verdict unless it is uncertain, else the analysis's."""
    return F.coalesce(F.nullif(parsed, F.lit("uncertain")), analysis)


def _searches(patterns: tuple[str, ...]) -> list[tuple[str, re.Pattern]]:
    """Each pattern with its longest plain word, whose search spares most texts the pattern."""
    return [(max(re.split(r"\\b|\[[^\]]*\]\??", p), key=len), re.compile(p, re.ASCII)) for p in patterns]


def _weight(text: str, searches: list[tuple[str, re.Pattern]]) -> float:
    """Matches of the patterns, those that start after LATE of the text twice."""
    return sum(2.0 if m.start() / len(text) > LATE else 1.0 for word, found in searches if word in text for m in found.finditer(text))


def extract_verdict(c: Column) -> Column:
    """A stated ``verdict: x``, else the side whose phrases weigh more; a tie is uncertain. Seventeen patterns, so in Arrow batches."""
    stated, fake, real = re.compile(r"verdict\s*:\s*(fake|real|uncertain)", re.ASCII), _searches(FAKE_PATTERNS), _searches(REAL_PATTERNS)

    def one(text: str) -> str:
        if "verdict" in text and (found := stated.search(text)):
            return found[1]
        difference = _weight(text, fake) - _weight(text, real)
        return "fake" if difference > 0 else "real" if difference < 0 else "uncertain"

    @F.pandas_udf(T.StringType())
    def said(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return said(F.lower(F.coalesce(c, F.lit(""))))


def extract_confidence(c: Column) -> Column:
    """A stated confidence in [0, 1] (above 1: percent), else the first percentage, else 0.5."""
    text = F.lower(F.coalesce(c, F.lit("")))
    stated = F.regexp_extract(text, r"confidence[:\s]+([0-9.]+)", 1)
    value = stated.try_cast("double")
    percent = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1)
    scaled = F.when(value > 1, value / 100).otherwise(value)
    read = F.when(stated != "", F.coalesce(scaled, F.lit(0.5))).when(percent != "", percent.try_cast("double") / 100).otherwise(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), read))


def text_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def content_hash(content: Column) -> Column:
    """The hash of a file's bytes; empty where it can't be read."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def nested(c: Column, *names: str) -> Column:
    """A value inside nested objects of a JSON text, as text; null if any step is missing."""
    path = "$" + "".join(f"['{name}']" for name in names)
    return F.try_variant_get(F.try_parse_json(c), path, "string")


def ordered_distinct(c: Column) -> Column:
    """The values of an array that are neither null nor empty, once each, in order of first appearance."""
    return F.array_distinct(F.filter(c, lambda v: F.coalesce(v, F.lit("")) != ""))


def map_hashes(c: Column) -> Column:
    """The hash of each value of a map."""
    return F.transform_values(c, lambda _, v: F.sha2(v, 256))


def canonical_params(c: Column) -> Column:
    """A map as JSON with sorted keys and without nulls."""
    kept = F.map_filter(c, lambda _, v: v.isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def canonical_json(c: Column) -> Column:
    """JSON text of any depth in one form: keys in order, no blanks, escapes and numbers as the engine writes them; null for no JSON.

    Numbers that are equal and have no exponent, or are whole and short with one,
    are written alike: 1, 1.0 and 1e0 are 1.
    """
    whole = r'("(?:[^"\\]++|\\.)*+")|(-?\d++)\.0(?![0-9E])'
    return F.regexp_replace(F.to_json(strict_json(c)), whole, "$1$2")


def fixed(c: Column, digits: int) -> Column:
    """A number with so many digits, rounded on its exact binary value.

    The engine's own formatters round the shortest decimal of a double, which
    differs at halves; so this is an Arrow-batched function.
    """

    @F.pandas_udf(T.StringType())
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return shown(c.cast("double"))


def cache_key(tool: Column, content_hash: Column, params: Column) -> Column:
    """File name of a cached tool output: the tool and 16 hex digits of its canonical key."""
    own = F.coalesce(F.size(F.map_filter(params, lambda _, v: v.isNotNull())), F.lit(0)) > 0
    body = F.concat(
        F.lit('{"image_hash":"'), content_hash, F.lit('"'), F.when(own, F.concat(F.lit(',"params":'), canonical_params(params))).otherwise(""), F.lit(',"tool":"'), tool, F.lit('"}')
    )
    return F.concat(tool, F.lit("_"), F.substring(F.sha2(body, 256), 1, 16), F.lit(".json"))


def format_bytes(c: Column) -> Column:
    """A size in units of base 1024: bytes whole, larger units with two digits; negative counts as 0."""
    n = F.greatest(c, F.lit(0))
    out = F.when(c.isNull(), "N/A").when(n < 1024, F.format_string("%d B", n.cast("long")))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(fixed(n / float(1024**power), 2), F.lit(f" {unit}")))
    return out.otherwise(F.concat(fixed(n / float(1024**4), 2), F.lit(" TiB")))


def format_seconds(c: Column) -> Column:
    """Seconds with fewer digits as they grow; N/A for null or negative."""
    shown = F.when(c < 1, fixed(c, 3)).when(c < 10, fixed(c, 2)).otherwise(fixed(c, 1))
    return F.when(c.isNull() | (c < 0), "N/A").otherwise(F.concat(shown, F.lit("s")))


def format_number(c: Column, digits: int = 3) -> Column:
    return F.coalesce(fixed(c.try_cast("double"), digits), F.lit("n/a"))


def markdown_cell(c: Column) -> Column:
    """A cell with pipes escaped and line ends as breaks; a dash for null."""
    return F.coalesce(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>"), F.lit("—"))


def bracketed(c: Column) -> Column:
    return F.concat(F.lit("["), c, F.lit("]"))


def only_value(v: Column) -> Column:
    """The value of a parsed array of one; null for one of more."""
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def braced(c: Column) -> Column:
    """What a text has from its first ``{`` to its last ``}``; empty without."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def strict_json(c: Column) -> Column:
    """A whole text as JSON; null if anything follows the value, which the engine's parser would not mind."""
    return only_value(F.try_parse_json(bracketed(c)))


def tolerant_json(c: Column) -> Column:
    """JSON text of a whole string, else of its first ``{`` to its last ``}``; null for neither."""
    return F.coalesce(strict_json(c), strict_json(braced(c)))


def looks_like_json(c: Column) -> Column:
    return F.ltrim(c).rlike(r"^[\{\[]")


def truncated(c: Column, n: int) -> Column:
    """At most n characters, the last three dots where something is left out."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def truncated_map(c: Column, n: int) -> Column:
    """The first n entries of a map; where some are left out, two entries say so."""
    kept = F.map_from_entries(F.slice(F.map_entries(c), 1, n))
    return F.when(F.size(c) <= n, c).otherwise(F.map_concat(kept, F.create_map(F.lit("__truncated__"), F.lit("true"), F.lit("__total_items__"), F.size(c).cast("string"))))


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def extension(path: Column) -> Column:
    """Lower-cased suffix of a path's name with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def parent(path: Column) -> Column:
    """The directory right above a path's name, or the path itself."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), path)


def media_type(path: Column) -> Column:
    out = F.lit("image/jpeg")
    for suffix, kind in MEDIA_TYPES.items():
        out = F.when(extension(path) == suffix, kind).otherwise(out)
    return out


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def tool_error(message: Column) -> Column:
    """Whether an error message is about a tool, by its words."""
    return F.lower(message).rlike("gpu|tool|aborted|cuda|memory|timeout|forensic|jpeg|python_code")


def jpeg_gate(path: Column) -> Column:
    """completed for JPEG files, skipped for others: the row stays."""
    return F.when(extension(path).isin(".jpg", ".jpeg"), "completed").otherwise("skipped")


def depiction(mode: Column) -> Column:
    return F.when(F.upper(F.trim(mode)).isin("1", "L", "LA"), "monotone").when(mode != "", "color").otherwise("unknown")


def compression_bucket(fmt: Column) -> Column:
    f = F.upper(F.trim(fmt))
    return F.when(f.isin("JPEG", "JPG", "WEBP"), "present").when(f.isin("PNG", "BMP", "TIFF", "TIF"), "not_present").otherwise("unable")


def checkbox(c: Column) -> Column:
    return F.when(c, "[x]").otherwise("[ ]")


def section(text: Column, start: str, end: str) -> Column:
    """What lies between two headings, trimmed; empty if either is missing."""
    a = F.instr(text, start)
    rest = F.substring(text, a + len(start), F.length(text))
    b = F.instr(rest, end)
    return F.when((a > 0) & (b > 0), F.trim(F.substring(rest, F.lit(1), b - 1))).otherwise("")


def letter_name(i: Column, first: int = 1) -> Column:
    """Number, letter and number of the i-th file, from 0: a hundred a letter, 26 letters a number."""
    letter = F.char(97 + F.floor(i / 100) % 26)
    return F.concat((F.floor(i / 2600) + first).cast("string"), letter, F.lit("_"), (i % 100 + 1).cast("string"))


def json_objects(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of each balanced object at the top level of a text, strings minded."""
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text):
        if depth and quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif depth and c == '"':
            quoted = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield start, i + 1, text[start : i + 1]


@F.pandas_udf(SPANS)
def json_spans(texts: pd.Series) -> pd.Series:
    """All valid JSON objects embedded in a text, with their places."""
    import json

    def valid(raw: str) -> bool:
        try:
            return isinstance(json.loads(raw), dict)
        except ValueError:
            return False

    return texts.map(lambda t: [{"start": a, "end": b, "json": raw} for a, b, raw in json_objects(t or "") if valid(raw)])


@F.udtf(returnType=T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("json", T.StringType())]))
class JsonSpans:
    """json_spans as a table function: one row an object."""

    def eval(self, text: str):  # noqa: ANN201
        for found in json_objects(text or ""):
            yield found


def frame_index(position: Column, frames: Column) -> Column:
    """Index of the frame at a relative position, never past the last."""
    return F.least((position * (frames - 1)).cast("int"), frames - 1)
