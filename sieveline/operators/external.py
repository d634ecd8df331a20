"""Columns that something outside the engine fills: detectors, denoisers, language models.

A client is made once for each Python worker by a factory that the caller gives,
so that weights are loaded where they are used; calls are timed, and an exception
becomes the row's error, not the query's.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image_bytes, text
from . import comparison

#: Clients of this Python worker.
_clients: dict[str, Callable[..., str]] = {}
OUTPUT = "output string, seconds double, status string, error string"


def called(df: DataFrame, keys: list[str], inputs: list[str], factory: Callable[[], Callable[..., str]]) -> DataFrame:
    """Keys and the client's output of each row, with its time and status."""
    kinds = dict(df.dtypes)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _clients:
            _clients[name] = factory()
        client = _clients[name]
        for batch in batches:
            rows = []
            for values in zip(*(batch[c] for c in inputs), strict=True):
                began = time.monotonic()
                try:
                    out, failure = client(*values), None
                except Exception as e:  # noqa: BLE001  a tool's failure is data
                    out, failure = None, str(e)
                rows.append((out, time.monotonic() - began, "error" if failure is not None else "completed", failure))
            found = pd.DataFrame(rows, columns=["output", "seconds", "status", "error"], index=batch.index, dtype=object)
            yield pd.concat([batch[keys], found], axis=1)

    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), OUTPUT]))


def called_once(df: DataFrame, cached: DataFrame, keys: list[str], inputs: list[str], factory: Callable[[], Callable[..., str]]) -> DataFrame:
    """As ``called``, but only for keys that the cache lacks; a failure in the cache counts as lacking."""
    return comparison.cached(df, cached, keys, lambda missing: called(missing, keys, inputs, factory))


def register(spark: SparkSession) -> list[str]:
    """The functions that SQL may call, by name."""
    spark.udf.register("json_spans", text.json_spans)
    spark.udtf.register("json_objects", text.JsonSpans)

    @F.pandas_udf("string")
    def image_format(content: pd.Series) -> pd.Series:
        return content.map(lambda data: image_bytes.image_format(bytes(data or b"")))

    @F.pandas_udf("string")
    def image_xmp(content: pd.Series) -> pd.Series:
        return content.map(lambda data: image_bytes.xmp(bytes(data or b"")))

    made = {"image_format": image_format, "image_xmp": image_xmp}
    for name, function in made.items():
        spark.udf.register(name, function)
    return ["json_spans", "json_objects", *made]


# The tools that an agent may call, with their arguments.
TOOLS = {
    "metadata": ("What a file's bytes say: tags, packets, profile, content credentials.", {"image_path": "string"}),
    "analyze_jpeg_compression": ("Format and traces of compression.", {"image_path": "string"}),
    "detect_jpeg_quantization": ("Quantisation tables and the quality nearest to them.", {"image_path": "string"}),
    "perform_ela": ("Error levels after recompression.", {"image_path": "string", "quality": "int"}),
    "analyze_frequency_domain": ("Spectra of a whole image.", {"image_path": "string"}),
    "extract_residuals": ("Statistics of what a denoiser takes away.", {"image_path": "string"}),
    "perform_trufor": ("A manipulation detector, plugged in as a client.", {"image_path": "string"}),
    "perform_cfa_detection": ("Traces of a colour filter in windows of an image.", {"mode": "string", "image_path": "string", "window": "int", "pattern": "string"}),
}


def registry(spark: SparkSession) -> DataFrame:
    """name, description and arguments (name to type) of every tool."""
    rows = [(name, said, arguments) for name, (said, arguments) in TOOLS.items()]
    return spark.createDataFrame(rows, "name string, description string, arguments map<string,string>")


def pluggable_verdicts(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Verdict and confidence of free answers without a model: the fallback of a structuring client."""
    return df.select(*keys, text.extract_verdict(F.col(answer)).alias("verdict"), text.extract_confidence(F.col(answer)).alias("confidence"))
