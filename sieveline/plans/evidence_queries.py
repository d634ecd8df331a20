"""Queries of tool evidence, requests, traces and files with known parts, each with its oracle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import inference, prompts, results
from ..operators import arrays, distribution, external, images, metrics
from ..session import spread, table
from .array_queries import LONG, WINDOWS, windows
from .bridge import oracle, records
from .metric_queries import metric_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


TOOLS = (*results.EVIDENCE, "other_tool")
_numbers = [f for fields in results.EVIDENCE.values() for f in fields.values() if f.isidentifier() and f not in ("quality", "is_jpeg", "coefficient_source", "format", "distribution")]
_numbers = tuple(dict.fromkeys(_numbers))
_shown = {
    "perform_trufor": ", manipulation_probability=V, detection_score=V", "perform_ela": ", anomaly_score=V, quality=Q", "detect_jpeg_quantization": ", is_jpeg=B, quality_estimate_primary=Q, sac_score=V",
    "analyze_jpeg_compression": ", format=F, is_jpeg=B, sac_score=V", "analyze_frequency_domain": ", fft_radial_decay=V, fft_peakiness=V, dct_mean=V",
    "extract_residuals": ", residual_energy_p95=V, residual_std=V, residual_kurtosis=V", "perform_cfa_detection": ", cfa_consistency_score=V", "other_tool": "",
}
_values = {"V": "printf('%.3f', value)", "Q": "(event_id % 100)::VARCHAR", "B": "CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END", "F": "event_type"}


def _line(tool: str) -> str:
    parts = "".join(f" || '{head}=' || ({_values[mark]})" for head, mark in (p.split("=") for p in _shown[tool].replace(", ", "|, ").split("|") if p))
    return f"'- {tool}: status=' || event_type{parts}"


_cases = " ".join(f"WHEN {i} THEN {_line(t)}" for i, t in enumerate(TOOLS))
_no_caveat = "(event_id % 8 IN (3, 7) OR (event_id % 8 = 2 AND event_id % 2 = 0))"


@query(
    f"SELECT event_id, (CASE event_id % 8 {_cases} END) || '|- plain: status=' || CASE WHEN event_id % 3 = 0 THEN 'unparsed' WHEN event_id % 3 = 1 THEN 'ok' ELSE 'unknown' END AS lines, "
    f"(event_id % 3 = 0)::INT AS unparsed, CASE WHEN {_no_caveat} THEN 0 ELSE 1 END AS caveats, CASE WHEN event_id % 8 = 0 THEN value END AS probability, "
    "CASE WHEN event_id % 8 IN (2, 3) THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END END AS is_jpeg, CASE WHEN event_id % 8 = 2 THEN event_id % 100 END AS primary_quality, "
    "CASE WHEN event_id % 3 = 0 THEN 'broken ' || props ELSE '-' END AS preview, CASE WHEN event_type = 'error' THEN 'at ' || event_id END AS error FROM events"
)
def fn22_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tools an event, one of eight and a plain one that may answer with no JSON; every answer has the event's values."""
    tool = F.get(F.array(*map(F.lit, TOOLS)), (F.col("event_id") % 8).cast("int"))
    quality, even = F.col("event_id") % 100, F.col("event_id") % 2 == 0
    answer = F.struct(
        F.col("event_type").alias("status"), *(F.col("value").alias(n) for n in _numbers), quality.alias("quality"), even.alias("is_jpeg"), F.create_map(F.lit("0"), quality).alias("quality_estimates"),
        F.lit("raw").alias("coefficient_source"), F.col("event_type").alias("format"), F.when(F.col("event_type") == "error", F.concat(F.lit("at "), F.col("event_id").cast("string"))).alias("error"),
    )
    turn = F.col("event_id") % 3
    plain = F.when(turn == 0, F.concat(F.lit("broken "), F.regexp_replace("props", r"\}$", ""))).when(turn == 1, 'so: {"status": "ok"}.').otherwise("{}")
    outputs = F.create_map(tool, F.to_json(answer), F.lit("plain"), plain)
    # dealt by event before answers are made, so that a small file's few splits don't bound the tasks; groups need no further shuffle
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props").repartition(spread(spark), "event_id")
    rows = events.select("event_id", tool.alias("asked"), outputs.alias("outputs"))
    found = results.normalised(rows, ["event_id", "asked"], "outputs")
    own, other = F.element_at("evidence", F.col("asked")), F.element_at("evidence", F.lit("plain"))
    preview = F.get_json_object(other, "$.raw_preview")
    return found.select(
        "event_id", F.array_join("summary_lines", "|").alias("lines"), F.size("parse_errors").alias("unparsed"), F.size("caveats").alias("caveats"),
        F.get_json_object(own, "$.manipulation_probability").cast("double").alias("probability"), F.get_json_object(own, "$.is_jpeg").alias("is_jpeg"),
        F.get_json_object(own, "$.quality_estimate_primary").cast("long").alias("primary_quality"),
        F.when(F.size("parse_errors") > 0, F.concat(preview, F.lit("}"))).otherwise("-").alias("preview"), F.get_json_object(own, "$.error").alias("error"),
    )


_files = ("x_GLM46V-vision_agent_glm46.jsonl", "G3_run.jsonl", "my_g3Vision_1.jsonl", "B_or_g3flashprev.jsonl", "plain.jsonl")
_agents = ("m0", "anthropic/claude-sonnet-4.5", "openai/gpt-5", "m3")
_file = "[" + ", ".join(f"'{f}'" for f in _files) + "][1 + user_id % 5]"
_agent = "[" + ", ".join(f"'{a}'" for a in _agents) + "][1 + user_id % 4]"


@query(
    f"""WITH e AS (SELECT user_id, lower({_file}) AS f, {_agent} AS a, CASE WHEN user_id % 3 = 0 AND event_type <> 'view' THEN 'v' || (event_id % 2) END AS v FROM events),
n AS (SELECT user_id, v, count(*) AS n FROM e WHERE v IS NOT NULL GROUP BY ALL), b AS (SELECT user_id, v FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) = 1),
u AS (SELECT DISTINCT user_id, f, a FROM e)
SELECT user_id, CASE WHEN v IS NOT NULL THEN v WHEN f LIKE '%glm46v-vision^_agent^_glm46%' ESCAPE '^' THEN 'z-ai/glm-4.6:nitro' WHEN f LIKE 'g3%' OR f LIKE '%g3vision%' OR f = 'b_or_g3flashprev.jsonl' THEN 'google/gemini-3-flash-preview'
  WHEN a LIKE '%claude-sonnet-4.5%' THEN 'anthropic/claude-sonnet-4.5' WHEN a LIKE '%gpt-5%' THEN 'gpt-5.2' ELSE 'google/gemini-3-flash-preview' END AS vision_model,
 CASE WHEN v IS NOT NULL THEN 'models_field' WHEN f LIKE '%glm46v-vision^_agent^_glm46%' ESCAPE '^' THEN 'filename_glm46_vision' WHEN f LIKE 'g3%' OR f LIKE '%g3vision%' THEN 'filename_g3_prefix' WHEN f = 'b_or_g3flashprev.jsonl' THEN 'filename_b_or_g3'
  WHEN a LIKE '%claude-sonnet-4.5%' THEN 'agent_rule_sonnet' WHEN a LIKE '%gpt-5%' THEN 'agent_rule_openai' ELSE 'default_gemini' END AS source FROM u LEFT JOIN b USING (user_id)"""
)
def fn40_vision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.get(F.array(*map(F.lit, _files)), (F.col("user_id") % 5).cast("int"))
    agent = F.get(F.array(*map(F.lit, _agents)), (F.col("user_id") % 4).cast("int"))
    said = F.when((F.col("user_id") % 3 == 0) & (F.col("event_type") != "view"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")))
    rows = table(spark, sf_dir, "events").select("user_id", file.alias("file"), agent.alias("model"), said.alias("vision_model"))
    return distribution.inferred_vision_model(rows, ("user_id",), "file")


@query(
    oracle(
        "SELECT model, use_tools, CASE WHEN least(a, b, c, d) = 0 THEN 'undefined (zero in denominator)' ELSE printf('MCC = (%d*%d - %d*%d) / sqrt[(%d+%d)(%d+%d)(%d+%d)(%d+%d)]', tp, tn, fp, fn, tp, fp, tp, fn, tn, fp, tn, fn) "
        "|| chr(10) || printf('    = (%d - %d) / sqrt[%d*%d*%d*%d]', tp * tn, fp * fn, a, b, c, d) || chr(10) || '    = ' || top || ' / sqrt[' || (a::HUGEINT * b * c * d) || ']' || chr(10) "
        "|| '    = ' || top || printf(' / %.2f', sqrt((a::HUGEINT * b * c * d)::DOUBLE)) || chr(10) || printf('    = %.4f', top / sqrt((a::HUGEINT * b * c * d)::DOUBLE)) END AS mcc, "
        "printf('Wilson CI (95%%, z=1.96):\n  p = %.4f, n = %d\n  z^2/n = %.6f\n  z^2/2n = %.6f\n', p, n, zz / n, zz / (2 * n)) || printf('  p(1-p)/n = %.6f\n  z^2/4n^2 = %.8f\n  SE term = sqrt(%.6f + %.8f) = %.6f\n', sp, sm, sp, sm, se) "
        "|| printf('  Margin = 1.96 * %.6f = %.6f\n  Denominator = 1 + %.6f = %.6f\n', se, 1.96 * se, zz / n, den) || printf('  Lower = (%.4f + %.6f - %.6f) / %.6f = %.4f\n', p, zz / (2 * n), 1.96 * se, den, lo) "
        "|| printf('  Upper = (%.4f + %.6f + %.6f) / %.6f = %.4f\n  95%% CI = [%.3f, %.3f]', p, zz / (2 * n), 1.96 * se, den, hi, lo, hi) AS wilson FROM z",
        *metric_ctes(),
        "x AS (SELECT *, tp + fp AS a, tp + fn AS b, tn + fp AS c, tn + fn AS d, tp * tn - fp * fn AS top, accuracy AS p, total AS n, 1.96::DOUBLE * 1.96::DOUBLE AS zz FROM m)",
        "y AS (SELECT *, p * (1 - p) / n AS sp, zz / (4.0::DOUBLE * n * n) AS sm, sqrt(p * (1 - p) / n + zz / (4.0::DOUBLE * n * n)) AS se, 1 + zz / n AS den FROM x)",
        "z AS (SELECT *, (p + zz / (2 * n) - 1.96::DOUBLE * se) / den AS lo, (p + zz / (2 * n) + 1.96::DOUBLE * se) / den AS hi FROM y)",
    )
)
def st02_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.compute_metrics(records(spark, sf_dir))
    cells = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    return found.select("model", "use_tools", inference.mcc_trace(*cells).alias("mcc"), inference.wilson_trace(F.col("accuracy"), F.col("total")).alias("wilson"))


@query(
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS referer, CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id END AS title, (page_id % 3 <> 0 AND page_id % 2 <> 0) AS nothing, "
    "CASE WHEN page_id % 5 = 0 THEN 'tag ' || page_id WHEN html IS NULL THEN 'unknown' ELSE 'baml:' || substr(sha256(html), 1, 16) END AS tag FROM pages"
)
def fn48_headers_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    named = F.concat(F.lit("page "), page.cast("string"))
    headers = results.header_map(F.when(page % 3 == 0, F.col("url")), F.when(page % 2 == 0, named).otherwise(""))
    tag = results.cache_tag(F.when(page % 5 == 0, F.concat(F.lit("tag "), page.cast("string"))), F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", headers.alias("h"), tag.alias("tag"))
    return rows.select("page_id", F.try_element_at("h", F.lit("HTTP-Referer")).alias("referer"), F.try_element_at("h", F.lit("X-Title")).alias("title"), F.col("h").isNull().alias("nothing"), "tag")


@query(
    "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'calibrate' WHEN 3 THEN 'calibrate' WHEN 4 THEN 'other' ELSE 'analyze' END AS mode, CASE event_id % 5 WHEN 0 THEN event_type || '.jpg' WHEN 2 THEN props || '.png' END AS image_path, "
    "CASE WHEN event_id % 5 = 1 THEN 'ref ' || event_type END AS folder, CASE WHEN event_id % 5 = 0 THEN 64 + event_id % 64 ELSE 256 END::INT AS window_size, CASE WHEN event_id % 5 = 0 THEN 'GRBG' ELSE 'RGGB' END AS pattern, "
    "CASE event_id % 5 WHEN 3 THEN 'a folder of reference images is needed to calibrate' WHEN 4 THEN 'mode must be analyze or calibrate' END AS error FROM events"
)
def kr32_pattern_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, kind = F.col("event_id") % 5, F.col("event_type")
    asked = F.struct(F.lit("DETECT").alias("mode"), F.concat(kind, F.lit(".jpg")).alias("image_path"), (F.col("event_id") % 64 + 64).alias("window"), F.lit("GRBG").alias("pattern"))
    raw = (
        F.when(turn == 0, F.to_json(asked)).when(turn == 1, F.to_json(F.struct(F.lit("calibrate").alias("mode"), F.concat(F.lit("ref "), kind).alias("ref_dir"))))
        .when(turn == 2, F.concat("props", F.lit(".png"))).when(turn == 3, '{"mode": "Calibrate", "neg_dir": ""}').otherwise('{"mode": "other"}')
    )
    rows = table(spark, sf_dir, "events").select("event_id", results.pattern_request(raw).alias("r"))
    return rows.select("event_id", "r.mode", "r.image_path", "r.folder", F.col("r.window").alias("window_size"), "r.pattern", "r.error")


@query(
    f"WITH {LONG}, w AS ({WINDOWS}) SELECT 'm' AS measure, round(min(m), 8) AS min_value, round(max(m), 8) AS max_value, round(avg(m), 8) AS mean_value, round(stddev_pop(m), 8) AS std_value, round(median(m), 8) AS median_value, "
    "count(DISTINCT vec_id) AS num_images, count(*) AS num_windows FROM w"
)
def ag34_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arrays.calibration(windows(spark, sf_dir), "vec_id", ["m"])
    return found.select(*(F.round(c, 8).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


@F.pandas_udf(T.BinaryType())
def _photo(key: pd.Series, maker: pd.Series, name: pd.Series, size: pd.Series) -> pd.Series:
    """A JPEG's segments with known tags: maker and orientation, an XMP packet, a colour profile."""
    import struct

    def segment(marker: int, body: bytes) -> bytes:
        return bytes((255, marker)) + struct.pack(">H", len(body) + 2) + body

    def one(k: int, make: str, title: str, n: int) -> bytes:
        order = "<" if k % 2 else ">"
        text = make.encode() + b"\0"
        entries = struct.pack(order + "HHII", 0x010F, 2, len(text), 38) + struct.pack(order + "HHIHH", 0x0112, 3, 1, 1 + n % 8, 0)
        tiff = (b"II*\0" if k % 2 else b"MM\0*") + struct.pack(order + "IH", 8, 2) + entries + b"\0\0\0\0" + text
        parts = [segment(0xE1, b"Exif\0\0" + tiff)]
        if n % 3:
            packet = f"<x:xmpmeta>{title}{' c2pa' if n % 3 == 2 else ''}</x:xmpmeta>"
            parts.append(segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + packet.encode()))
        if k % 4 == 0:
            said = b"profile\0"
            parts.append(segment(0xE2, b"ICC_PROFILE\0\1\1" + b"x" * n + b"desc\0\0\0\0" + struct.pack(">I", len(said)) + said))
        return b"\xff\xd8" + b"".join(parts) + b"\xff\xda\0\2\xff\xd9"

    return pd.Series([one(*row) for row in zip(key, maker, name, size, strict=True)])


@query(
    "SELECT p_partkey, 'completed' AS status, 'JPEG' AS format, p_brand AS make, (1 + p_size % 8)::VARCHAR AS orientation, 2 AS tag_count, "
    "CASE WHEN p_size % 3 <> 0 THEN '<x:xmpmeta>' || p_name || CASE WHEN p_size % 3 = 2 THEN ' c2pa' ELSE '' END || '</x:xmpmeta>' END AS xmp, "
    "CASE WHEN p_partkey % 4 = 0 THEN p_size + 20 ELSE 0 END::INT AS icc_bytes, CASE WHEN p_partkey % 4 = 0 THEN 'profile' END AS icc_description, CASE WHEN p_size % 3 = 2 THEN 'c2pa,xmp:c2pa' ELSE '' END AS hints FROM part"
)
def kr01_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos written with each part's values, read back from their bytes."""
    files = table(spark, sf_dir, "part").select("p_partkey", _photo("p_partkey", "p_brand", "p_name", "p_size").alias("content"))
    found = images.metadata(files, ["p_partkey"])
    return found.select(
        "p_partkey", "status", "format", F.element_at("exif", "Make").alias("make"), F.element_at("exif", "Orientation").alias("orientation"), "tag_count", "xmp", F.coalesce("icc_bytes", F.lit(0)).alias("icc_bytes"),
        "icc_description", F.array_join("credential_hints", ",").alias("hints"),
    )


@query(
    "SELECT p_partkey, (1 + p_size % 4)::INT AS manifests, CASE WHEN p_size % 4 = 0 THEN [p_brand] WHEN p_size % 4 = 1 THEN [p_brand, p_name] ELSE [p_brand, p_name, p_type] END AS generators, (p_size % 3)::INT AS failure, (p_size % 5)::INT AS success, "
    "'m' || (p_size % 4) AS active FROM part"
)
def ag28_credential_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with as many manifests and findings as each part's size says."""
    makers = F.array("p_brand", "p_name", "p_type", "p_brand")
    count = (F.col("p_size") % 4 + 1).cast("int")
    manifests = F.map_from_entries(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.concat(F.lit("m"), i.cast("string")), F.struct(F.get(makers, i).alias("claim_generator")))))

    def some(n) -> object:  # noqa: ANN001
        return F.array_repeat(F.lit("x"), n.cast("int"))

    found = F.struct(some(F.col("p_size") % 3).alias("failure"), some(F.col("p_size") % 5).alias("success"))
    raw = F.to_json(F.struct(F.concat(F.lit("m"), (F.col("p_size") % 4).cast("string")).alias("active_manifest"), manifests.alias("manifests"), found.alias("validation_results")))
    rows = table(spark, sf_dir, "part").select("p_partkey", results.credential_report(raw).alias("r"))
    return rows.select("p_partkey", "r.manifests", "r.generators", "r.failure", "r.success", "r.active")


@query("SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN upper(p_name) END AS output, CASE WHEN p_size % 7 = 0 THEN 'error' ELSE 'completed' END AS status, CASE WHEN p_size % 7 = 0 THEN 'no ' || p_name END AS error FROM part")
def ud02_timed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    def factory():  # noqa: ANN202
        def client(name: str, size: int) -> str:
            if size % 7 == 0:
                raise ValueError(f"no {name}")
            return name.upper()

        return client

    found = external.called(table(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_size"], factory)
    return found.filter("seconds >= 0").select("p_partkey", "output", "status", "error")


@query(
    "SELECT conv_id, turn, replace(replace('" + prompts.AGENT.replace("'", "''") + "', '{path}', '/' || conv_id || '.png'), '{summary}', coalesce(text, '')) AS prompt, "
    "replace('" + prompts.RETRY.replace("'", "''").replace("{summary}", "") + "', '{previous}', coalesce(text, '')) AS again FROM conversations"
)
def fn49_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", prompts.agent_prompt(F.col("text"), path).alias("prompt"), prompts.retry_prompt(F.lit(None), F.col("text")).alias("again"))
