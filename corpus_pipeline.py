"""The corpus pipeline over documents: five stages, each over what the one before it kept.

Every stage but the last returns the columns of documents. Its decisions take effect: rejected
documents go, of near copies one stays, contaminated documents go, the mix repeats or leaves out
documents, and the last stage writes the token ids of what is left and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_dedup, quality, token_store
from tessera.llm.common import save, table
from tessera.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL cannot express the classifier or the tokenizer; tests/llm/test_pipeline.py holds each stage's rows
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
