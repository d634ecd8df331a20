"""Readers of manifests, result records, metric documents, images and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extension

MANIFEST = "id string, image string, image_path string, label string, ground_truth string, meta map<string,string>"
RESULT = (
    "id string, model string, use_tools boolean, trial int, label string, image string, meta map<string,string>, prediction string, analysis_verdict string, "
    "parsed_verdict string, confidence double, rationale string, raw_analysis string, models struct<agent:string,vision:string,structuring:string>, "
    "tool_usage array<string>, tool_details array<struct<tool:string,seconds:double,status:string,error:string>>, "
    "tool_results array<struct<tool:string,seconds:double,status:string,error:string,parsed:string,raw_truncated:string>>, "
    "timings struct<vision_llm_seconds:double,agent_graph_seconds:double,total_seconds:double>, latency_seconds double, error string, error_type string, "
    "prompts map<string,string>, prompt_hashes map<string,string>, visual_description string, forensic_summary string, raw_response string, "
    "token_usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>"
)
CONFUSION = "confusion struct<tp:long,tn:long,fp:long,fn:long>, support struct<real:long,fake:long>"
METRICS = f"total long, correct long, answered long, accuracy double, accuracy_answered double, coverage double, abstain_count long, error_count long, {CONFUSION}"
IMAGE_GLOB = "*.{png,jpg,jpeg,bmp,tif,tiff,webp,PNG,JPG,JPEG,BMP,TIF,TIFF,WEBP}"


def _stem(path):  # noqa: ANN001, ANN202
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def resolved_manifest(rows: DataFrame, base: str) -> DataFrame:
    """id, image, label and meta of manifest rows: aliases by first non-empty, paths against ``base``.

    An image or label that is missing stops the query with the row's text: a
    manifest is a contract.
    """
    first = {"image": ("image", "image_path"), "label": ("label", "ground_truth")}
    found = {k: F.coalesce(*(F.nullif(F.col(a), F.lit("")) for a in names)) for k, names in first.items()}
    need = {k: F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"manifest row without {k}"))) for k, v in found.items()}
    path = F.when(F.startswith(need["image"], F.lit("/")) | need["image"].rlike("^[a-z0-9+]+://"), need["image"]).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), need["image"]))
    rows = rows.withColumns({"_path": path, "_label": F.lower(F.trim(need["label"]))})
    return rows.select(F.coalesce(F.nullif("id", F.lit("")), _stem(F.col("_path"))).alias("id"), F.col("_path").alias("image"), F.col("_label").alias("label"), "meta")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines manifest; blank lines are left out."""
    return resolved_manifest(spark.read.schema(MANIFEST).json(path), path.rsplit("/", 1)[0])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result records of JSON-lines files, with file name, key and bad lines set apart.

    ``_corrupt`` holds the text of a line that is no record; such rows have no
    other value. ``_key`` names a record within its file.
    """
    rows = spark.read.schema(RESULT + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("file_name", F.col("_metadata.file_name"))
    trial = F.coalesce(F.col("trial"), F.lit(0)).cast("string")
    key = F.concat_ws("_", "id", "model", F.initcap(F.col("use_tools").cast("string")), trial)
    return rows.withColumn("_key", F.when(F.col("_corrupt").isNull(), key))


def discovered_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files of a folder by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return found.select("path", "length", "modificationTime").orderBy("path")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """file_name, model, mode and metrics of metric documents' trial 0; documents that are no JSON give nothing."""
    docs = spark.read.text(path, wholetext=True).withColumn("file_name", F.col("_metadata.file_name"))
    fields = ",".join(":".join(part.strip().split(" ", 1)) for part in _split(METRICS))
    inner = f"map<string,struct<per_trial:map<string,struct<{fields}>>>>"
    rows = docs.select("file_name", F.explode(F.from_json("value", inner)).alias("config", "doc")).filter("config <> '_meta'")
    rows = rows.select("file_name", "config", F.try_element_at("doc.per_trial", F.lit("0")).alias("m")).filter("m IS NOT NULL")
    bar = F.instr("config", "|") > 0
    mode = F.when(bar, F.substring_index("config", "|", -1)).otherwise("unknown")
    model = F.when(bar, F.expr("left(config, length(config) - length(substring_index(config, '|', -1)) - 1)")).otherwise(F.col("config"))
    return rows.select("file_name", model.alias("model"), mode.alias("mode"), "m.*")


def _split(fields: str) -> list[str]:
    """Fields of a schema text at its top level."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a tool cache: one for each tool, content and parameters, the latest."""
    rows = spark.read.schema("tool string, image_hash string, params string, output string, status string, written double").json(path)
    order = Window.partitionBy("tool", "image_hash", "params").orderBy(F.desc("written"))
    return rows.withColumn("_turn", F.row_number().over(order)).filter("_turn = 1").drop("_turn")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Expert reviews of a progress document, a row for each sample."""
    one = "struct<reasoning_quality:int,reasoning_valid:boolean,tool_interpretation_correct:boolean,fabrication_suspected:boolean,verdict_agree:boolean,expert_verdict:string,notes:string,timestamp:string>"
    from .writers import current

    docs = spark.read.text(current(spark, path), wholetext=True)
    return docs.select(F.explode(F.from_json(F.get_json_object("value", "$.evaluations"), f"map<string,{one}>")).alias("sample_key", "r")).select("sample_key", "r.*")


def list_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, length and content of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", "true").load(folder).select("path", "length").orderBy("path")


def label_of_path(path):  # noqa: ANN001, ANN201
    """fake or real by the first directory that says so; real without one."""
    parts = F.filter(F.split(path, "/"), lambda p: F.lower(p).isin("fake", "real"))
    return F.lower(F.coalesce(F.get(parts, F.lit(0)), F.lit("real")))


def labelled_images(spark: SparkSession, folder: str) -> DataFrame:
    """path and label of all images below a folder."""
    return list_images(spark, folder, recursive=True).select("path", label_of_path(F.col("path")).alias("label"))


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, rgb (bytes, by rows) and status of images that the JVM decodes.

    A file that it can't decode keeps its row, with status error and no pixels.
    """
    from ..operators.images import rgb_bytes

    rows = spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")
    good = F.col("height") > 0
    sizes = (F.when(good, F.col(c)).alias(c) for c in ("height", "width"))
    return rows.select(F.col("origin").alias("path"), *sizes, rgb_bytes("nChannels", "data").alias("rgb"), F.when(good, "completed").otherwise("error").alias("status"))


def byte_prefix(content, n: int):  # noqa: ANN001, ANN201
    """The first bytes of content that is read already; ``prefixes.read_prefixes`` reads no more than them."""
    return F.substring(content, 1, n)


def is_image(path):  # noqa: ANN001, ANN201
    return extension(path).isin(".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
