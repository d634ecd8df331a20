"""The registered queries of the training-data operators: thin views of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, html_text, language, lexical, media, mixing, neardup, ngram_join, quality, sketch, toxicity, urls, variants


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    path = known.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, known.PATTERN, ids=False)


def op8_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_progressive_jpeg, op3_scaled_sketch, op4_setsketch_dedup, op5_quality, op6_toxicity, op7_byte_bpe, op8_url_vocabulary, op9_main_text, op10_language, op11_spelling_variants, op12_count_vector_join, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.sql(), "op4_setsketch_dedup": neardup.sql(), "op8_url_vocabulary": urls.sql(), "op11_spelling_variants": variants.sql(), "op12_count_vector_join": ngram_join.sql(), "op13_lexical_search": lexical.sql()}
