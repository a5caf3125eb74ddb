"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelode.llm._common import table


def op1_crf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op6_hamming_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codelode.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.pii import report

    return report(table(spark, sf_dir, "documents")).drop("scores")


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.langid import predict

    return predict(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.centroids import kmeans

    return kmeans(table(spark, sf_dir, "embeddings"))


def op12_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.prefix_trie import shared_prefixes

    return shared_prefixes(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from codelode.llm.oracles import SQL

    return dict(SQL)
