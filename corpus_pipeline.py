"""Corpus pipeline: the documents of a training corpus, filtered, deduplicated and tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns they were given: the
quality classifier drops documents that it rejects, exact and near deduplication keep one document
of each group (the largest and the smallest doc_id), decontamination drops documents that hold a
benchmark passage. The last stage encodes what is left and decodes it again.

Defined results: rows are dropped by id and text together, so a decision takes effect on the rows it was made for
even where ids are null or repeated; rows that share both are one document. Null and empty texts have no quality and
go in the first stage; without any label of trusted text it keeps every document with text. Texts of any length
are taken whole. Equal texts keep the largest id, near copies the smallest; rows without an id are no near
copies of any. Extra columns are kept as they are; an empty table passes through all stages and gives no rows.
``run`` deletes each stage's intermediates once its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontam, exact_dedup, quality, simhash
from tessera.llm.shared import drop_path, new_path, swept, table

#: The stages read whole texts and learn from the corpus itself; SQL cannot express them.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with swept(spark) as keep_path:
            path = new_path(spark, f"pipeline-{name}")
            keep_path(path)
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
