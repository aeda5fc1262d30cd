"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import base_folder, spread

#: rows that a Python worker turns into objects at once
ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so other columns and their names play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shielded(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``keep`` under names no operator uses, and the way back to its own columns."""
    names = docs.columns
    hidden = [c if c in keep else f"_x{k}" for k, c in enumerate(names)]
    return docs.toDF(*hidden), lambda df: df.select([F.col(h).alias(c) for h, c in zip(hidden, names)])


def without(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` without columns that have one of ``names``, in any case: an operator's own results take their place."""
    taken = {n.lower() for n in names}
    inner = [f"_x{k}" for k in range(len(docs.columns))]
    return docs.toDF(*inner).select([F.col(i).alias(c) for i, c in zip(inner, docs.columns) if c.lower() not in taken])


def held_out(buckets: int, value: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``buckets``, equals ``value``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets == value


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` at a time: bounds the Python objects that are alive at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``fn`` to ``ROWS`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, sliced(batches, ROWS))

    return df.mapInArrow(run, schema)


def merged_batches(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    """Joins consecutive batches into tables of about ``max_bytes``."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint(eager)
