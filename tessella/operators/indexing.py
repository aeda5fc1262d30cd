"""Embedding and index state as tables: pending work, last-wins upserts, index rows.

Nothing loops over batches on the driver: pending rows are anti joins, model
calls run in Arrow batches in the executors, and a failed task is simply redone.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import small_batches

DIM = 64
EMBED_BATCH = 4
ATTEMPTS = 6
#: calls whose texts and vectors are Python objects at once
CALLS = 16
# The index's schema, chunk columns in its order.
INDEX_FIELDS = (
    "chunk_id", "source", "source_pdf_url", "source_pdf_name", "chunk_index", "page_start", "page_end", "heading_level", "topic", "subtopic",
    "section_title", "section", "region", "energy_utility_name", "content", "content_type", "has_table", "has_figure", "is_table", "is_figure",
    "table_count", "figure_count",
)
_WORDS = re.compile(r"[^\W_]+")


class RateLimited(Exception):
    """An embedder asks to be called again."""


def hash_embedding(texts: list[str]) -> list[list[float]]:
    """Deterministic default: word counts hashed by md5 to ``DIM`` signed places, of length one."""
    out = np.zeros((len(texts), DIM))
    for k, t in enumerate(texts):
        for w in _WORDS.findall(t.lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            out[k, int(h[:8], 16) % DIM] += 1 if int(h[8], 16) < 8 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]] = hash_embedding, batch: int = EMBED_BATCH, attempts: int = ATTEMPTS, wait: float = 0.0, kind: str = "float") -> DataFrame:
    """chunk_id, vector of ``kind``; each call gets at most ``batch`` texts and is repeated while the embedder is limited.

    A worker holds the texts of a small Arrow batch, and as objects those of ``CALLS`` calls with their vectors, however many rows a task has.
    """
    small_batches(chunks.sparkSession)
    step = batch * CALLS

    def call(texts: list[str]) -> list[list[float]]:
        for k in range(attempts):
            try:
                return embedder(texts)
            except RateLimited:
                time.sleep(wait * 2**k)
        raise RuntimeError(f"embedder still limited after {attempts} attempts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            texts = [t or "" for t in b.column("content").to_pylist()]
            vectors = [v for k in range(0, len(texts), batch) for v in call(texts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(vectors, pa.list_(pa.float64() if kind == "double" else pa.float32()))], ["chunk_id", "vector"])

    return chunks.select("chunk_id", "content").mapInArrow(run, f"chunk_id string, vector array<{kind}>")


def vector_lines(lines: DataFrame) -> DataFrame:
    """(seq, line) of a JSON-lines cache to (chunk_id, vector, seq), up to the first malformed line."""
    parsed = lines.where(F.trim("line") != "").select("seq", F.from_json("line", "chunk_id string, vector array<float>", {"mode": "PERMISSIVE"}).alias("v"), F.try_parse_json("line").isNull().alias("bad"))
    parsed = parsed.withColumn("bad", F.col("bad") | F.col("v.chunk_id").isNull())
    first = parsed.where("bad").agg(F.min("seq").alias("stop"))
    return parsed.join(F.broadcast(first)).where("stop is null or seq < stop").select("v.chunk_id", "v.vector", "seq")  # one row


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """The last vector of every chunk."""
    return vectors.groupBy("chunk_id").agg(F.max_by("vector", "seq").alias("vector"))


def pending_embed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def pending_upload(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    return chunks.join(uploads.where("uploaded").select("chunk_id"), "chunk_id", "left_anti")


def metadata_json(metadata: dict) -> str:
    return json.dumps(metadata, ensure_ascii=False)


def index_documents(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index rows of the chunks that have a vector: pages 0 where unknown, metadata as JSON."""
    from tessella.operators.sessions import spaced_json

    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("page_start", "page_end")}
    joined = chunks.join(latest_vectors(vectors), "chunk_id")
    return joined.select(*[zero.get(c, F.col(c)) for c in INDEX_FIELDS], spaced_json(F.to_json("metadata")).alias("metadata_json"), F.col("vector").alias("content_vector"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``new`` replace those with their key; nothing is deleted."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def run_pipeline(chunks: DataFrame, vectors: DataFrame, uploads: DataFrame, embedder=hash_embedding) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New vectors, index rows to upsert and upload marks, as one plan."""
    todo = pending_upload(chunks, uploads)
    last = latest_vectors(vectors)
    made = embed(pending_embed(todo, last), embedder)
    every = last.unionByName(made).withColumn("seq", F.lit(0))
    rows = index_documents(todo, every)
    return made, rows, rows.select("chunk_id", F.lit(True).alias("uploaded"))


def stats(chunks: DataFrame, vectors: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row: chunks, with tables, with figures, utilities, vectors cached, uploaded."""
    a = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("has_table").alias("with_tables"), F.count_if("has_figure").alias("with_figures"), F.array_join(F.array_sort(F.collect_set("energy_utility_name")), ",").alias("utilities"))
    b = vectors.agg(F.countDistinct("chunk_id").alias("vectors_cached"))
    c = uploads.agg(F.count_if("uploaded").alias("uploaded"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # single rows


def reindex(ids: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows of the chunk ids asked for, and the ids that lack a chunk or a vector."""
    wanted = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = index_documents(wanted, vectors)
    return rows, ids.select("chunk_id").distinct().join(rows.select("chunk_id"), "chunk_id", "left_anti")


def facets(index: DataFrame, field: str) -> DataFrame:
    return index.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
