"""Functions of result records, tool runs and model answers as column expressions.

Tool runs are arrays of (tool, seconds, status, error, parsed), parsed being JSON text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import braced, bracketed, fixed, json_objects, normalize_verdict, only_value, strict_json, tolerant_json

# The fields of each tool's evidence with where its answer has them, and those that its summary shows:
# with three digits, or as they are with what stands for none.
EVIDENCE = {
    "perform_trufor": {"manipulation_probability": "manipulation_probability", "detection_score": "detection_score"},
    "perform_ela": {"ela_anomaly_score": "ela_anomaly_score", "quality": "quality"},
    "detect_jpeg_quantization": {"is_jpeg": "is_jpeg", "quality_estimate_primary": "quality_estimates['0']", "sac_score": "sac_score", "coefficient_source": "coefficient_source"},
    "analyze_jpeg_compression": {"format": "format", "is_jpeg": "is_jpeg", "sac_score": "sac_score"},
    "analyze_frequency_domain": {"fft_radial_decay": "fft_radial_decay", "fft_peakiness": "fft_peakiness", "dct_mean": "dct_mean"},
    "extract_residuals": {"residual_energy_p95": "residual_energy_p95", "residual_std": "residual_std", "residual_kurtosis": "residual_kurtosis"},
    "perform_cfa_detection": {"cfa_consistency_score": "cfa_consistency_score", "distribution": "distribution"},
}
SHOWN = {
    "perform_trufor": (("manipulation_probability", None), ("detection_score", None)),
    "perform_ela": (("ela_anomaly_score", None), ("quality", "n/a")),
    "detect_jpeg_quantization": (("is_jpeg", "None"), ("quality_estimate_primary", "None"), ("sac_score", None)),
    "analyze_jpeg_compression": (("format", "None"), ("is_jpeg", "None"), ("sac_score", None)),
    "analyze_frequency_domain": (("fft_radial_decay", None), ("fft_peakiness", None), ("dct_mean", None)),
    "extract_residuals": (("residual_energy_p95", None), ("residual_std", None), ("residual_kurtosis", None)),
    "perform_cfa_detection": (("cfa_consistency_score", None),),
}
RENAMED = {"ela_anomaly_score": "anomaly_score"}
#: Tools that an answer may name itself; the others go by the name under which they ran.
SELF_NAMED = tuple(t for t in EVIDENCE if t != "perform_cfa_detection")
#: Characters of an answer without known fields that are kept.
PREVIEW = 200
#: What each tool's reading is limited by; parameters, shown once each.
CAVEATS = {
    "perform_trufor": "A low manipulation probability does not rule out a fully synthetic image.",
    "perform_ela": "Error levels also follow benign processing; even levels prove nothing.",
    "analyze_frequency_domain": "Spectra follow resizing, compression and content; auxiliary evidence only.",
    "extract_residuals": "Residuals follow the denoiser, content and compression; auxiliary evidence only.",
    "perform_cfa_detection": "Filter patterns are of use for demosaiced photos; others may lack them.",
}
NOT_JPEG = "Quantisation tables say nothing about files that are no JPEG."
#: Key field of each tool's display, and from where it is alarming.
DISPLAY = {"perform_trufor": ("manipulation_probability", 0.5), "perform_ela": ("ela_anomaly_score", 2.0)}


def summary_row(df: DataFrame) -> DataFrame:
    """A record's key fields with defaults, whether it is right (null-safe), and how many tools it used."""
    d = {"id": "unknown", "model": "unknown", "label": "unknown", "prediction": "unknown"}
    return df.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit(v)).alias(c) for c, v in d.items()), F.coalesce("use_tools", F.lit(False)).alias("use_tools"),
        F.coalesce("trial", F.lit(0)).alias("trial"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("prediction").eqNullSafe(F.col("label")).alias("is_correct"),
        F.coalesce(F.size("tool_usage"), F.lit(0)).alias("tool_count"), F.coalesce("latency_seconds", F.lit(0.0)).alias("latency_seconds"),
    )


def tool_info(runs: Column) -> Column:
    """Name, status, seconds and error of each run, with defaults."""
    unknown = F.lit("unknown")
    return F.transform(
        runs,
        lambda r: F.struct(
            F.coalesce(r["tool"], unknown).alias("name"), F.coalesce(r["status"], unknown).alias("status"), F.coalesce(r["seconds"], F.lit(0.0)).alias("seconds"), r["error"].alias("error")
        ),
    )


def tool_states(df: DataFrame, keys: list[str], runs: str = "tool_results") -> DataFrame:
    """For each tool of a record: its runs, the last run's status and seconds, and the last answer that is not empty."""
    long = df.select(*keys, F.posexplode(runs).alias("at", "r")).filter("coalesce(r.tool, '') <> ''")
    full = F.coalesce(F.col("r.parsed"), F.lit("{}")) != "{}"
    return long.groupBy(*keys, F.col("r.tool").alias("tool")).agg(
        F.count("*").alias("runs"), F.coalesce(F.nullif(F.max_by("r.status", "at"), F.lit("")), F.lit("unknown")).alias("status"), F.max_by("r.seconds", "at").alias("seconds"),
        F.max_by(F.when(full, F.col("r.parsed")), F.when(full, F.col("at"))).alias("parsed"),
    )


def badge(prediction: Column, label: Column) -> tuple[Column, Column]:
    """Whether a verdict is right, any case, and the colour of what it says."""
    p = F.lower(F.coalesce(prediction, F.lit("")))
    return p == F.lower(F.coalesce(label, F.lit(""))), F.when(p == "fake", "red").when(p == "real", "green").otherwise("grey")


def display(tool: Column, parsed: Column) -> tuple[Column, Column]:
    """The key value of a tool's answer, and red or green by its bound."""
    value, colour = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (field, bound) in DISPLAY.items():
        own = F.get_json_object(parsed, f"$.{field}").try_cast("double")
        value = F.when(tool == name, own).otherwise(value)
        colour = F.when((tool == name) & own.isNotNull(), F.when(own > bound, "red").otherwise("green")).otherwise(colour)
    return value, colour


def built_result(text: Column) -> Column:
    """Verdict, confidence, rationale and description of a model's answer in JSON, with defaults."""
    v = tolerant_json(text)

    def said(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    confidence = F.coalesce(said("confidence").try_cast("double"), F.lit(0.0))
    return F.struct(
        normalize_verdict(F.coalesce(said("verdict"), F.lit(""))).alias("verdict"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        F.coalesce(said("rationale"), F.lit("")).alias("rationale"),
        F.coalesce(F.nullif(said("visual_description"), F.lit("")), said("visual_summary"), F.lit("")).alias("visual_description"),
    )


@F.pandas_udf(T.StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first object in a text; null if that is not valid, whatever follows."""

    def one(text: str | None) -> str | None:
        for _, _, raw in json_objects(text or ""):
            try:
                return raw if isinstance(json.loads(raw), dict) else None
            except ValueError:
                return None
        return None

    return texts.map(one)


def answer_payload(text: Column, spans: Column) -> Column:
    """The JSON of a final answer: the whole text, else the last object with a verdict, else the last with a confidence,
    else what stands after the words themselves."""
    parsed = tolerant_json(text)
    whole = F.when(parsed.isNotNull(), F.to_json(parsed))

    def last(field: str) -> Column:
        return F.try_element_at(F.filter(spans, lambda s: F.get_json_object(s["json"], f"$.{field}").isNotNull()), F.lit(-1))["json"]

    verdict = F.nullif(F.lower(F.regexp_extract(text, r"(?i)\bverdict\b\s*[:\-]\s*(real|fake|uncertain|inconclusive)\b", 1)), F.lit(""))
    confidence = F.regexp_extract(text, r"(?i)\bconfidence\b[^0-9]{0,30}([01](?:\.\d+)?)\b", 1).try_cast("double")
    words = F.when(verdict.isNotNull() | confidence.isNotNull(), F.to_json(F.struct(verdict.alias("verdict"), confidence.alias("confidence"))))
    return F.coalesce(whole, last("verdict"), last("confidence"), words)


def _kind(tool: Column, v: Column) -> Column:
    """The tool whose fields an answer has: the first that ran under its name, or that the answer names."""
    said = F.try_variant_get(v, "$.tool", "string")
    kind = F.lit(None).cast("string")
    for name in reversed(EVIDENCE):
        kind = F.when((tool == name) | (said == name) if name in SELF_NAMED else tool == name, name).otherwise(kind)
    return kind


def _values(kind: Column, v: Column) -> list[Column]:
    """The numbers that a summary shows with three digits, by their place in it: of each place only that of the answer's own tool."""
    out = []
    for at in range(max(map(len, SHOWN.values()))):
        own = F.lit(None).cast("double")
        for name, fields in SHOWN.items():
            if at < len(fields) and fields[at][1] is None:
                own = F.when(kind == name, F.try_variant_get(v, f"$.{EVIDENCE[name][fields[at][0]]}", "double")).otherwise(own)
        out.append(fixed(own, 3))
    return out


def _line(tool: Column, v: Column, kind: Column, values: list[Column]) -> Column:
    """The summary of an answer, of its tool and its numbers as text."""
    status = F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("unknown"))
    shown = F.lit("")
    for name, fields in SHOWN.items():
        parts = []
        for (field, none), value in zip(fields, values):
            if none is not None:
                value = F.try_variant_get(v, f"$.{EVIDENCE[name][field]}", "string")
                value = F.initcap(value) if field == "is_jpeg" else value
            parts.append(F.concat(F.lit(f", {RENAMED.get(field, field)}="), F.coalesce(value, F.lit(none or "n/a"))))
        shown = F.when(kind == name, F.concat(*parts)).otherwise(shown)
    return F.concat(F.lit("- "), F.when(v.isNull(), tool).otherwise(F.coalesce(kind, tool)), F.lit(": status="), F.when(v.isNull(), "unparsed").otherwise(F.concat(status, shown)))


def summary_line(tool: Column, raw: Column) -> Column:
    """A tool's output in one line: its status and key fields; unparsed if it is no JSON object.

    As one expression it reads the answer anew for each field; ``normalised`` reads it once.
    """
    v = _answer(raw)
    kind = _kind(tool, v)
    return _line(tool, v, kind, _values(kind, v))


def _answer(raw: Column) -> Column:
    """An answer as a JSON object; null for anything else."""
    return _object(tolerant_json(raw))


def _object(v: Column) -> Column:
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def evidence(tool: Column, raw: Column) -> Column:
    """The stable fields of a tool's output as JSON, with status and error; a preview for what has none."""
    v = _answer(raw)
    return _fields(raw, v, _kind(tool, v))


def _fields(raw: Column, v: Column, kind: Column) -> Column:
    status = F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("unknown")).alias("status")
    error = F.try_variant_get(v, "$.error", "variant").alias("error")
    preview = F.substring(raw, 1, PREVIEW).alias("raw_preview")
    whole = {"ignoreNullFields": "false"}
    out = F.to_json(F.struct(status, error, preview), whole)
    for name, fields in EVIDENCE.items():
        own = F.struct(status, *(F.try_variant_get(v, f"$.{path}", "variant").alias(field) for field, path in fields.items()), error)
        out = F.when(kind == name, F.to_json(own, whole)).otherwise(out)
    return F.when(v.isNull(), F.to_json(F.struct(F.lit("unparsed").alias("status"), preview), whole)).otherwise(out)


def normalised(df: DataFrame, keys: list[str], outputs: str) -> DataFrame:
    """Keys, evidence by tool, summary_lines, caveats and parse_errors of a map of raw outputs by tool.

    Lists are in the order of the map, caveats once each. A null or empty map
    has empty lists. Keys must tell rows apart.
    """
    long = df.select(*keys, F.posexplode_outer(F.map_entries(outputs)).alias("at", "e")).select(*keys, "at", F.col("e.key").alias("tool"), F.col("e.value").alias("raw"))
    # columns of their own: an answer is parsed once, not once for each of its fields
    tool, v, kind = F.col("tool"), F.col("v"), F.col("kind")
    long = long.withColumn("v", F.try_parse_json(bracketed(F.col("raw"))))
    long = long.withColumn("v", F.coalesce(only_value(v), strict_json(braced(F.col("raw")))))
    long = long.withColumn("v", _object(v)).withColumn("kind", _kind(tool, v))
    values = _values(kind, v)
    names = [f"value_{i}" for i in range(len(values))]
    long = long.withColumns(dict(zip(names, values)))
    other = F.when(F.try_variant_get(v, "$.is_jpeg", "boolean") == False, NOT_JPEG)  # noqa: E712
    caveat = F.when(kind == "detect_jpeg_quantization", other).otherwise(F.element_at(F.create_map(*(F.lit(x) for pair in CAVEATS.items() for x in pair)), kind))
    found = long.withColumns({"line": _line(tool, v, kind, [F.col(n) for n in names]), "fields": _fields(F.col("raw"), v, kind), "caveat": caveat, "bad": v.isNull()})
    rows = F.sort_array(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("at", "tool", "line", "fields", "caveat", "bad"))))
    found = found.groupBy(*keys).agg(rows.alias("r"))
    return found.select(
        *keys, F.map_from_entries(F.transform("r", lambda x: F.struct(x["tool"], x["fields"]))).alias("evidence"), F.col("r.line").alias("summary_lines"),
        F.array_distinct(F.array_compact("r.caveat")).alias("caveats"), F.transform(F.filter("r", lambda x: x["bad"]), lambda x: x["tool"]).alias("parse_errors"),
    )


def caveats(tools: Column) -> Column:
    """The limits of the tools used, once each, in order."""
    found = F.transform(tools, lambda t: F.element_at(F.create_map(*(F.lit(x) for pair in CAVEATS.items() for x in pair)), t))
    return F.array_distinct(F.array_compact(found))


def pattern_request(raw: Column) -> Column:
    """What a request of the filter-pattern tool asks for, with defaults; anything but a JSON object is the path of an image.

    Older names of the mode mean analyze; an unknown mode, and a calibration
    without a folder, are errors of the request.
    """
    v = strict_json(raw)
    kind = F.schema_of_variant(v)
    object_ = F.startswith(kind, F.lit("OBJECT"))

    def said(name: str, type_: str) -> Column:
        return F.when(object_, F.try_variant_get(v, f"$.{name}", type_))

    mode = F.lower(F.coalesce(said("mode", "string"), F.lit("analyze")))
    mode = F.when(mode.isin("detect", "visualize"), "analyze").otherwise(mode)
    path = F.when(object_, said("image_path", "string")).when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(raw)
    folder = F.coalesce(F.nullif(said("neg_dir", "string"), F.lit("")), F.nullif(said("ref_dir", "string"), F.lit("")))
    error = F.when(~mode.isin("analyze", "calibrate"), "mode must be analyze or calibrate").when((mode == "calibrate") & folder.isNull(), "a folder of reference images is needed to calibrate")
    return F.struct(
        mode.alias("mode"), path.alias("image_path"), folder.alias("folder"), F.coalesce(said("window", "int"), F.lit(256)).alias("window"), F.coalesce(said("pattern", "string"), F.lit("RGGB")).alias("pattern"),
        F.coalesce(said("channel", "string"), F.lit("G")).alias("channel"), F.coalesce(said("top_k", "int"), F.lit(5)).alias("top_k"), F.coalesce(said("outlier_zscore", "double"), F.lit(2.0)).alias("outlier_zscore"), error.alias("error"),
    )


def header_map(referer: Column, title: Column) -> Column:
    """The optional headers of a client as a map; null without any."""
    pairs = F.array(F.struct(F.lit("HTTP-Referer").alias("k"), referer.alias("v")), F.struct(F.lit("X-Title").alias("k"), title.alias("v")))
    kept = F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != "")
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def cache_tag(named: Column, prompts: Column) -> Column:
    """What tells cached vision outputs apart: a given tag, else 16 hex digits of the prompts, else unknown."""
    made = F.concat(F.lit("baml:"), F.substring(F.sha2(prompts, 256), 1, 16))
    return F.coalesce(F.nullif(named, F.lit("")), made, F.lit("unknown"))


def credential_report(raw: Column) -> Column:
    """Counts and the first claim generators of a content-credentials report in JSON."""
    manifests = F.from_json(F.get_json_object(raw, "$.manifests"), "map<string,struct<claim_generator:string>>")
    makers = F.filter(F.transform(F.map_values(manifests), lambda m: m["claim_generator"]), lambda g: g.isNotNull() & (g != ""))

    def n(path: str) -> Column:
        return F.coalesce(F.json_array_length(F.get_json_object(raw, path)), F.lit(0))

    return F.struct(
        F.get_json_object(raw, "$.active_manifest").alias("active"), F.coalesce(F.size(manifests), F.lit(0)).alias("manifests"), F.slice(F.array_distinct(makers), 1, 8).alias("generators"),
        n("$.validation_status").alias("statuses"), n("$.validation_results.success").alias("success"), n("$.validation_results.informational").alias("informational"),
        n("$.validation_results.failure").alias("failure"),
    )


def int_pair(c: Column) -> Column:
    """Two whole numbers of an array of two; null otherwise."""
    a, b = (F.get(c, F.lit(i)).try_cast("int") for i in (0, 1))
    return F.when((F.size(c) == 2) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))
