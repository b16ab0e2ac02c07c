"""From raw documents to packed sequences: five stages, each written as Parquet and read back for the next.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: one document of each group of near duplicates stays;
3. suffix-array dedup: passages that an earlier document holds are cut out;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontaminate, jaccard_join, packing, quality, shared, substring_dedup
from veilframe.llm.queries import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has read is deleted once its own rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, shared.staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        shared.drop(before)
    return docs
