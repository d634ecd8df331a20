"""A training-data pipeline over documents: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each stage's rows as Parquet in the session's shared checkpoint folder and reads
them again, so a stage never recomputes the ones before, and a lost executor
costs its own tasks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, language, mixing, neardup, quality
from sieveline.session import Tables, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is und, or less sure than this, is rejected.
SURE = 0.5
#: SQL can't express the classifiers, so the stages are tested against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (op 5)."""
    return quality.score(docs, table(spark, sf_dir, "labels"), keep=True).filter("predicted = 1").select(docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows (op 10)."""
    named = language.predict(docs, keep=True)
    return named.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id (op 4).

    Five-word shingles. Rows that repeat an id that stays, or have none, stay
    once for each text. Whole texts are shuffled once, by id.
    """
    kept = neardup.near_components(docs, k=5).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    one = stay.groupBy("doc_id", "text").agg(F.min(F.struct("source", "lang", "n_chars")).alias("one"))
    return one.select("doc_id", "text", "one.*").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (op 1)."""
    return mixing.copies(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of their decoded bytes (op 7)."""
    import public_tokenizers as known

    return bpe.encode(docs, known.path("byte_bpe_multi_50k.tiktoken"), known.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over all documents; a stage's table goes when the next one's is written."""
    tables = Tables(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for at, (_, stage) in enumerate(STAGES):
        docs = tables.keep(f"stage{at}", stage(spark, docs, sf_dir))
        if at:
            tables.drop(f"stage{at - 1}")
    return docs
