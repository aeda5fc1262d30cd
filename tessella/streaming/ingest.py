"""Incremental drivers: documents to chunks to an index, and session files to rows.

Streams: a checkpoint takes the place of processed markers. Folders: a manifest
tells which files have changed since. Each batch overwrites its own folder of
every table, so a batch that is repeated after a failure leaves the same rows;
readers keep the last batch of every key.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import chunking, indexing, sessions
from tessella.sources import files
from tessella.sources.files import path_columns
from tessella.sources.scratch import written

#: changed files whose names are given to the scan; beyond, all are read and joined
NAMED = 10_000


def markdown_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """source, utility, text of Markdown files as they arrive."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", per_batch).text(folder, wholetext=True)
    return files.select(*path_columns(F.col("_metadata.file_path")), F.col("value").alias("text"))


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls ``step`` with all that has arrived since the checkpoint, batch by batch."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Writes ``step`` of every batch to a folder of its own."""
    each_batch(stream, lambda batch, number: step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}"), checkpoint)


KEY = ("source", "utility")


def _save(spark: SparkSession, docs: DataFrame, out: str, batch: int) -> DataFrame:
    """The batch's chunks and its files, those without any chunk too."""
    chunking.chunk_documents(docs).write.mode("overwrite").parquet(f"{out}/chunks/batch={batch}")
    chunks = spark.read.parquet(f"{out}/chunks/batch={batch}")
    n = chunks.groupBy("source", F.col("energy_utility_name").alias("utility")).agg(F.count(F.lit(1)).alias("n"))
    signed = [c for c in ("mtime", "size") if c in docs.columns]
    docs.select(*KEY, *signed).join(n, list(KEY), "left").withColumn("n", F.coalesce("n", F.lit(0))).write.mode("overwrite").parquet(f"{out}/files/batch={batch}")
    return chunks


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Documents as they arrive to chunks."""
    each_batch(stream, lambda docs, batch: _save(docs.sparkSession, docs, out, batch), checkpoint)


def latest_files(spark: SparkSession, out: str) -> DataFrame:
    """The last batch of every file, with what was noted of it."""
    noted = spark.read.parquet(f"{out}/files")
    last = noted.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in noted.columns if c not in KEY]), "batch").alias("r"))
    return last.select(*KEY, "r.*")


def latest_chunks(spark: SparkSession, out: str, present: DataFrame | None = None) -> DataFrame:
    """The chunks of every document's last batch; of those in ``present`` (source, utility) only, if given."""
    rows, last = spark.read.parquet(f"{out}/chunks"), latest_files(spark, out).select(*KEY, "batch")
    if present is not None:
        last = last.join(present.select(*KEY), list(KEY), "left_semi")
    last = last.select(F.col("source").alias("s"), F.col("utility").alias("u"), F.col("batch").alias("b"))
    return rows.join(last, (F.col("source") == F.col("s")) & F.col("energy_utility_name").eqNullSafe(F.col("u")) & (F.col("batch") == F.col("b")), "left_semi").drop("batch")


def chunk_folder(spark: SparkSession, folder: str, cache: str, glob: str = "*.md", force: bool = False) -> DataFrame:
    """Chunks of all Markdown files below a folder; files of the same name, folder, time and size come from the cache."""
    docs = files.read_markdown(spark, folder, glob)
    now = docs.select(*KEY, "mtime", "size")
    todo = now
    if not force and files.exists(spark, f"{cache}/files"):
        todo = now.join(latest_files(spark, cache), [*KEY, "mtime", "size"], "left_anti")
    todo = written(todo)
    n = todo.count()
    if n:
        if n <= NAMED:
            docs = docs.where(F.col("source").isin([r.source for r in todo.select("source").distinct().collect()]))
        _save(spark, docs.join(todo, [*KEY, "mtime", "size"], "left_semi"), cache, time.time_ns())
    if not files.exists(spark, f"{cache}/files"):
        return chunking.chunk_documents(docs)  # of no files
    return latest_chunks(spark, cache, now)


def clear_cache(spark: SparkSession, cache: str) -> bool:
    return files.delete(spark, cache)


STATE = {"vectors": "chunk_id string, vector array<float>, batch long", "uploads": "chunk_id string, uploaded boolean, batch long"}


def _state(spark: SparkSession, store: str, name: str, batch: int) -> DataFrame:
    """A table of the store, without what an earlier try of this batch left."""
    at = f"{store}/{name}"
    rows = spark.read.schema(STATE[name]).parquet(at) if files.exists(spark, at) else spark.createDataFrame([], STATE[name])
    return rows.where(F.col("batch") != batch)


def index_chunks(spark: SparkSession, chunks: DataFrame, store: str, batch: int, embedder=indexing.hash_embedding) -> dict[str, int]:
    """Embeds and indexes what the store does not have yet; how many chunks were embedded, indexed, and left for another try."""
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{store}/{name}/batch={batch}")
    todo = written(indexing.pending_upload(chunks, _state(spark, store, "uploads", batch)))
    known = _state(spark, store, "vectors", batch).withColumnRenamed("batch", "seq")
    put(indexing.embed(indexing.pending_embed(todo, known), embedder), "vectors")
    made = spark.read.schema("chunk_id string, vector array<float>").parquet(f"{store}/vectors/batch={batch}")
    put(indexing.index_documents(todo, known.unionByName(made.withColumn("seq", F.lit(batch).cast("long")))), "index")
    rows = spark.read.parquet(f"{store}/index/batch={batch}")
    put(rows.select("chunk_id", F.lit(True).alias("uploaded")), "uploads")
    n = rows.count()
    return {"embedded": made.count(), "indexed": n, "left": todo.count() - n}


def read_index(spark: SparkSession, store: str) -> DataFrame:
    """The last row of every chunk id."""
    rows = spark.read.parquet(f"{store}/index")
    return rows.groupBy(F.col("chunk_id").alias("k")).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("r")).select("r.*")


def index_folder(spark: SparkSession, folder: str, store: str, embedder=indexing.hash_embedding, recreate: bool = False, clear_vectors: bool = False) -> dict[str, int]:
    """The index job: a folder's chunks to the store's index. ``recreate`` drops the index and its marks, ``clear_vectors`` the cached vectors and marks."""
    for name in [*(["index", "uploads"] if recreate else []), *(["vectors", "uploads"] if clear_vectors else [])]:
        files.delete(spark, f"{store}/{name}")
    return index_chunks(spark, chunk_folder(spark, folder, f"{store}/cache"), store, time.time_ns(), embedder)


def ingest_clients(stream: DataFrame, store: str, checkpoint: str, embedder=indexing.hash_embedding) -> None:
    """Documents as they arrive to chunks, vectors, index rows and marks, with a manifest of files."""

    def step(docs: DataFrame, batch: int) -> None:
        chunks = _save(docs.sparkSession, docs, f"{store}/cache", batch)
        index_chunks(docs.sparkSession, chunks, store, batch, embedder)

    each_batch(stream, step, checkpoint)


def backup(stream: DataFrame, out: str, checkpoint: str, now: str) -> None:
    """Session JSON (column ``raw``) to rows as it arrives."""
    run_available(stream, lambda b: sessions.flatten(b, now), out, checkpoint)


def nightly(spark: SparkSession, folder: str, out: str, now: str) -> dict[str, int]:
    """The nightly job: rows of all session files to ``out``, then the files that held JSON are deleted; how many of each."""
    if not files.exists(spark, folder):
        return {"rows_inserted": 0, "blobs_deleted": 0}
    seen = written(files.read_json(spark, folder).where("raw is not null"))  # files that come meanwhile wait for the next night
    target = f"{out}/batch={time.time_ns()}"
    sessions.flatten(seen, now).write.parquet(target)
    deleted = sum(files.delete(spark, r.path) for r in seen.select("path").toLocalIterator())
    return {"rows_inserted": spark.read.parquet(target).count(), "blobs_deleted": deleted}
