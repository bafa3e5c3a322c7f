"""A corpus pipeline: toxicity, exact and near deduplication, mixing to source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cuegrain.llm.common import cut
from cuegrain.llm.exact_dedup import drop_exact_copies
from cuegrain.llm.mixing import mixed_documents
from cuegrain.llm.near_dedup import drop_near_copies
from cuegrain.llm.packing import best_fit_packing
from cuegrain.llm.toxicity import drop_toxic


#: Rows handed to Python at a time. Whole texts may be long, and each task holds some copies of such a batch.
BATCH_ROWS = 2_000


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


#: Words whose ids a packing task remembers: workers stay for the next stages, and so would what they hold.
KNOWN_WORDS = 200_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, known_words=KNOWN_WORDS).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", _in_small_batches(without_toxic)),
    ("exact_dedup", _in_small_batches(without_exact_copies)),
    ("near_dedup", _in_small_batches(without_near_copies)),
    ("mixing", _in_small_batches(mixed)),
    ("packing", _in_small_batches(packed)),
]

#: The toxicity stage is a trained model, which SQL cannot express; tests hold the stages of deduplication
#: against brute force, and toxicity, mixing and packing against their operators and invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
