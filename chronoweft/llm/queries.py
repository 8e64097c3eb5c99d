"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoweft.llm import ann, decontaminate, divergence, mixing, near_dup, packing, periodic, quality, sharding, substring_dup, training_order, urlfilter, warc

#: The vocabulary of byte_bpe_50k.json as ranks; both files give the same ids.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_two_level_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=1024, end=2)


def op5_column_wise_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dup.remove_repeats(table(spark, sf_dir, "documents"), substring_dup.Cut(length=100))


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(urlfilter.fetch_times(pages), urlfilter.intervals(urlfilter.sample_events(pages)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10))


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_training_order,
        op2_two_level_warc_index,
        op3_cross_polytope_search,
        op4_best_fit_packing,
        op5_column_wise_dedup,
        op6_hash_tree_shards,
        op7_tensored_minhash,
        op8_cube_mix,
        op9_line_first_quality,
        op10_temporal_url_lists,
        op11_periodic_runs,
        op12_source_divergence,
        op13_suffix_decontamination,
    )
}
ORACLES = {"op2_two_level_warc_index": warc.ORACLE, "op10_temporal_url_lists": urlfilter.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_suffix_decontamination": decontaminate.ORACLE}
