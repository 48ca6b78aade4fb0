"""Corpus pipeline: quality rules, language identification, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm import langid, packing, rules, simhash, spans
from lipika.session import written

#: Rows in an Arrow batch. A worker holds a batch's texts and what it makes of them, so this bounds its memory.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches for the stages: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy ``full-2``."""
    return rules.passing(docs, "full-2")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages; a missing ``lang`` is filled in."""
    bounded(spark)
    found, name = langid.predict(docs, langid.fit(docs))
    kept = found.filter(~F.col(f"{name}.rejected") & (F.col(f"{name}.language") != langid.UNKNOWN))
    return kept.withColumn("lang", F.coalesce("lang", F.col(f"{name}.language"))).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of their 5-word shingles)."""
    bounded(spark)
    return simhash.keep_one(docs, **simhash.WIDE).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of runs that occurred before; ``n_chars`` follows the text."""
    bounded(spark)
    found = spans.remove_repeats(docs).select(docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 1024 tokens."""
    bounded(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing_stage),
]

#: SQL can express neither the models nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
