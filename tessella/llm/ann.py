"""Approximate nearest neighbours by cross-polytope hashing.

A table's pseudo-rotation is three rounds of random signs and a fast Hadamard
transform; a unit vector falls to the nearest signed axis of the rotated space,
and the axes of ``hashes`` rotations make a bucket's code. Their number grows
with the vectors (the logarithm to the base of the signed axes, one at least),
so that a bucket holds about as many at any size. Every vector is in one bucket
of each of ``tables`` tables; a query looks into the buckets of each whose axes
are nearest to it, ``probes`` times ``STEP`` for each further rotation.

Queries are taken in blocks of bounded size: a block's vectors and probed codes
are broadcast, and a scan of the vectors (with their codes, written once where
there are several blocks) finds which queries probe a vector's buckets. A
vector and a query that share several buckets meet once, and are scored by their
exact cosine; a task keeps the best of each query. So vectors are neither
copied into buckets nor shuffled, and a bucket of any size, be it copies of one
vector, is spread over the tasks that read it. Queries that met fewer than k
others are then compared with every vector in the same way.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part; vectors of different lengths are not compared. Ties go to the smaller
id; rows that repeat an id and vector count once; an id with several vectors
asks with each and is found by its nearest; rows with a null id take no part; an
empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, map_arrow, merged_batches
from tessella.sources.scratch import shared_folder, written

TABLES = 24
PROBES = 4
STEP = 12
#: queries in a block, and components of all of them
QUERIES = 4096
NUMBERS = 1 << 21
ROWS_BYTES = 2 << 20
#: vector-query pairs looked at together, and components of pairs scored together
PAIRS = 1 << 22
SCORED = 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of every row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def hashes_for(n: int, dim: int) -> int:
    """Rotations to a code: about one vector to a bucket, or a few."""
    axes = 2 * _width(dim)
    return max(1, int(math.log(max(n, 2)) / math.log(axes) + 1e-9))


def _width(dim: int) -> int:
    return max(2, 1 << (dim - 1).bit_length())


@cache
def _signs(table: int, rotation: int, width: int) -> np.ndarray:
    return np.random.default_rng([table, rotation, width]).choice(np.array([-1.0, 1.0]), (3, width))


def _turned(x: np.ndarray, table: int, rotation: int) -> np.ndarray:
    width = _width(x.shape[1])
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in _signs(table, rotation, width):
        y = hadamard(y * s)
    return y


@cache
def _matrix_of(table: int, rotation: int, dim: int) -> np.ndarray:
    return _turned(np.eye(dim), table, rotation)


def rotated(x: np.ndarray, table: int, rotation: int) -> np.ndarray:
    """Every row's rotation; up to 256 dimensions one product with the transform's own matrix is the faster way to it."""
    return x @ _matrix_of(table, rotation, x.shape[1]) if x.shape[1] <= 256 else _turned(x, table, rotation)


def bucket_codes(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """The bucket of every vector in every table; rows x tables."""
    out = np.zeros((len(x), tables), np.int64)
    at = np.arange(len(x))
    for t in range(tables):
        for k in range(hashes):
            y = rotated(x, t, k)
            axis = np.abs(y).argmax(1)
            out[:, t] = out[:, t] * (2 * y.shape[1]) + 2 * axis + (y[at, axis] < 0)
    return out


@cache
def _combined(a: int, b: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in two sorted lists whose sums can be among the ``most`` largest."""
    i, j = np.meshgrid(np.arange(a), np.arange(b), indexing="ij")
    keep = (i + 1) * (j + 1) <= most
    return i[keep], j[keep]


def probed_codes(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of every vector, nearest first."""
    code, gain = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k in range(hashes):
        y = rotated(x, table, k)
        near = np.stack([y, -y], 2).reshape(len(x), -1)
        axes = np.argsort(-near, 1, kind="stable")[:, :probes]
        i, j = _combined(code.shape[1], axes.shape[1], probes)
        both = gain[:, i] + np.take_along_axis(near, axes, 1)[:, j]
        keep = np.argsort(-both, 1, kind="stable")[:, :probes]
        code = np.take_along_axis(code[:, i] * near.shape[1] + axes[:, j], keep, 1)
        gain = np.take_along_axis(both, keep, 1)
    return code


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, always summed in the same order."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


class Block:
    """Queries of one length, and who probes which bucket; with no codes all queries meet all vectors."""

    def __init__(self, number: np.ndarray, vectors: np.ndarray, codes: np.ndarray | None):
        self.number, self.vectors = number, vectors  # codes: queries x tables x probes
        self.tables = None if codes is None else []
        for t in range(0 if codes is None else codes.shape[1]):
            flat = codes[:, t].reshape(-1)
            order = np.argsort(flat, kind="stable")
            self.tables.append((flat[order], (order // codes.shape[2]).astype(np.int32)))

    def met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of all that share a bucket, each pair once."""
        if self.tables is None:
            i, j = np.meshgrid(np.arange(len(codes)), np.arange(len(self.number)), indexing="ij")
            return i.reshape(-1), j.reshape(-1)
        seen = np.zeros((len(codes), len(self.number)), bool)
        for t, (sorted_codes, owner) in enumerate(self.tables):
            low, high = (np.searchsorted(sorted_codes, codes[:, t], side) for side in ("left", "right"))
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seen[np.repeat(np.arange(len(codes)), n), owner[at]] = True
        return np.nonzero(seen)


class Best:
    """The ``k`` best distinct ids of every query of a block."""

    def __init__(self, block: Block, k: int):
        self.block, self.k, self.pairs = block, k, 0
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, score
        self.floor = np.full(len(block.number), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        step = max(1, PAIRS // len(self.floor))
        for a in range(0, len(ids), step):
            self._add(ids[a : a + step], x[a : a + step], codes[a : a + step])

    def _add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        i, j = self.block.met(codes)
        self.pairs += len(i)
        parts = [self.held]
        step = max(1, SCORED // x.shape[1])
        for a in range(0, len(i), step):
            row, query = i[a : a + step], j[a : a + step]
            score = _cosines(self.block.vectors[query], x[row])
            good = score >= self.floor[query]
            parts.append((query[good], ids[row[good]], score[good]))
        query, who, score = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((who, -score, query))
        query, who, score = query[order], who[order], score[order]
        # an id's best score comes first; further ones of it are not counted
        by_id = np.lexsort((np.arange(len(who)), who, query))
        again = np.zeros(len(who), bool)
        again[by_id[1:]] = (query[by_id[1:]] == query[by_id[:-1]]) & (who[by_id[1:]] == who[by_id[:-1]])
        query, who, score = query[~again], who[~again], score[~again]
        first = np.searchsorted(query, np.arange(len(self.floor)))
        rank = np.arange(len(query)) - first[query]
        full = query[rank == self.k - 1]
        self.floor[full] = score[rank == self.k - 1]
        keep = rank < self.k
        self.held = (query[keep], who[keep], score[keep])


def _met(index: DataFrame, blocks: dict[int, Block], k: int) -> DataFrame:
    """(q, vec_id, score): the best ``k`` of every task for every query; ``blocks`` by length of vector."""
    shared = index.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for t in merged_batches(batches, ROWS_BYTES):
            v, codes = t.column("v").combine_chunks(), t.column("codes").combine_chunks()
            ids, sizes = t.column("vec_id").to_numpy(), np.diff(np.asarray(v.offsets))
            for dim in np.unique(sizes).tolist():
                if dim in shared.value:
                    at = np.nonzero(sizes == dim)[0]
                    some = pa.array(at)
                    best.setdefault(dim, Best(shared.value[dim], k)).add(ids[at], _matrix(v.take(some)), np.asarray(codes.take(some).flatten(), np.int64).reshape(len(at), -1))
        for b in best.values():
            query, who, score = b.held
            yield pa.RecordBatch.from_pydict({"q": pa.array(b.block.number[query]), "vec_id": pa.array(who), "score": pa.array(score)})

    return index.select("vec_id", "v", "codes").mapInArrow(run, "q long, vec_id long, score double")


def _coded(rows: DataFrame, hashes: dict[int, int], tables: int) -> DataFrame:
    """``rows`` (vec_id, v) with codes, the bucket in each table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = batch.column("v")
        sizes = np.diff(np.asarray(v.offsets))
        out = np.zeros((len(sizes), tables), np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.nonzero(sizes == dim)[0]
            out[at] = bucket_codes(_matrix(v.take(pa.array(at))), tables, hashes.get(dim, 1))
        codes = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), pa.array(out.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), v, codes], ["vec_id", "v", "codes"])

    return map_arrow(rows, run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, codes array<bigint>")


def _probing(queries: DataFrame, hashes: dict[int, int], tables: int, probes: int) -> DataFrame:
    """``queries`` (h1, h2, q, v) with the codes of all buckets that they look into, table by table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = batch.column("v")
        sizes = np.diff(np.asarray(v.offsets))
        out: list[bytes] = [b""] * len(sizes)
        for dim in np.unique(sizes).tolist():
            at = np.nonzero(sizes == dim)[0]
            x = _matrix(v.take(pa.array(at)))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            n = hashes[dim]
            small = (2 * _width(dim)) ** n < 1 << 31
            each = np.stack([probed_codes(x, t, n, probes * STEP ** (n - 1)) for t in range(tables)], 1).astype(np.int32 if small else np.int64)
            for k, one in zip(at.tolist(), each):
                out[k] = one.tobytes()
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "q")), v, pa.array(out, pa.binary())], ["h1", "h2", "q", "v", "codes"])

    return map_arrow(queries.select("h1", "h2", "q", "v"), run, f"h1 long, h2 long, q long, v {queries.schema['v'].dataType.simpleString()}, codes binary")


def _blocks(queries: DataFrame, hashes: dict[int, int], tables: int) -> dict[int, Block]:
    """The queries of a block, brought to the driver; without ``hashes`` they are to meet all."""
    got = queries.toArrow().sort_by("q")
    number, v = got.column("q").to_numpy(), got.column("v").combine_chunks()
    sizes, out = np.diff(np.asarray(v.offsets)), {}
    for dim in np.unique(sizes).tolist():
        at = np.nonzero(sizes == dim)[0]
        codes = None
        if hashes:
            flat = b"".join(got.column("codes").take(pa.array(at)).to_pylist())
            small = (2 * _width(dim)) ** hashes[dim] < 1 << 31
            codes = np.frombuffer(flat, np.int32 if small else np.int64).reshape(len(at), tables, -1)
        out[dim] = Block(number[at], _matrix(v.take(pa.array(at))), codes)
    return out


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES, hashes: int | None = None, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` marks, itself left out."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    # equal vectors, known by two hashes of their components, ask once
    asked = rows.where("asks").select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks")).where("asks > 0").collect()}
    per_code = {dim: hashes or hashes_for(n, dim) for dim, n in sizes.items()}
    once = asked.groupBy("h1", "h2").agg(F.first("v").alias("v")).withColumn("q", F.monotonically_increasing_id())
    queries = checkpointed(_probing(once, per_code, tables, probes))
    folder = shared_folder(embeddings.sparkSession)
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        one = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "vec_id", "score")

    def searched(index: DataFrame, queries: DataFrame, probing: bool) -> DataFrame:
        held = queries.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
        n = max(1, math.ceil(held[0] / block), math.ceil((held[1] or 0) / NUMBERS))
        if n > 1:
            index = written(index)
        for b in range(n):
            these = queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b)
            top(_met(index, _blocks(these, per_code if probing else {}, tables), k + 1)).write.parquet(f"{folder}/{probing}-{b}")
        return embeddings.sparkSession.read.schema("q long, vec_id long, score double").parquet(f"{folder}/{probing}-*")

    near = searched(_coded(rows.select("vec_id", "v"), per_code, tables), queries, True)
    met = near.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    short = checkpointed(queries.join(met, "q", "left").where(F.coalesce("n", F.lit(0)) <= k).select("q", "v"))
    if not short.isEmpty():  # the exact way for queries that the tables served too little
        everything = rows.select("vec_id", "v", F.array().cast("array<bigint>").alias("codes"))
        near = top(near.unionByName(searched(everything, short, False)))
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("near"))
    lists = queries.select("h1", "h2", "q").join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(lists, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
