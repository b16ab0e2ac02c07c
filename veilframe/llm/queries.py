"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_held_out

    return score_held_out(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import measured

    return measured(table(spark, sf_dir, "documents"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sst_output import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op11_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import report

    return report(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_best_fit_packing, op3_exact_top_k, op4_decontaminate, op5_substring_dedup, op6_warc_round_trip, op7_quality_scores, op8_token_counts, op9_jaccard_join, op10_token_tables, op11_exponion_clusters, op12_whitening, op13_byte_bpe)}
