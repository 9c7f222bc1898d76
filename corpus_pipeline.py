"""A training-data pipeline of five operators; part of the subpackage llm.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's docs. All but the last keep the columns of
documents. SQL can't express the trained, hashed and packed stages, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, packing, pii, quality, simhash
from lakeloom.llm.common import drop_table, materialize, only_result, table, unused
from lakeloom.llm.queries import surrogate_key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier scores below its threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, and of rows of equal id and text one."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its edit budget."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def surrogate_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates for personal data; n_chars follows a changed text."""
    (count,) = unused(docs.columns, "_replaced")
    out = pii.replace_pii(docs, surrogate_key(spark), keep_count=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack; a row for each piece of a document."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_benchmark_leaks), ("pii", surrogate_personal_data), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is deleted once the next one is written; the last is read when the result is taken."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with only_result(spark) as keep:
            new = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(new)
        if k:
            drop_table(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
