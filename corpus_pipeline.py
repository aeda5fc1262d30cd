"""Corpus pipeline: five training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; its result is written as Parquet and read again. All but the last
return the columns of ``documents``.

Defined cases: texts that are null or have no letter go in the first stage;
texts that line dedup leaves empty have fingerprint zero and so become one
document; the other cases are the operators' own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, langid, lines, pieces, simhash
from tessella.llm.common import held_out, table
from tessella.sources.scratch import shared_folder


#: documents in an Arrow batch; what the JVM and a Python worker hold of texts at once is in proportion to it
BATCH = 1000


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with Arrow batches of at most ``BATCH`` rows in its session from then on (unless that asks for fewer)."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence."""
    model = langid.fit(langid.sample(docs, ~held_out(5, 0)))
    return langid.recognised(docs, model)


@bounded
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that an earlier document has."""
    return lines.dedup(docs)


@bounded
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return simhash.keep_one(docs)


@bounded
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document of which a twentieth is test items, and no span of them in any other."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@bounded
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their digests and the text decoded from them."""
    return pieces.encode(docs, pieces.default_model())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL expresses neither the trained models nor the hashes; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
