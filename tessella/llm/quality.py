"""Quality classifier: random-indexing word vectors, a two-layer network.

A text is a series of units: words (lower-cased), their shapes (case and
length), and runs of one sign or of digits. Units are hashed to ``BUCKETS``
rows. Every row has a sparse random index vector (``MARKS`` signed places); its
context vector is the sum, over the whole corpus, of the index vectors of the
units one and two places away. Tasks add up their own tables, which are then
summed row by row: the result has ``BUCKETS`` x ``DIM`` numbers at any size.
A text is the average of its units' vectors (context and index, each of length
one), and its score comes from a two-layer network trained in numpy on at most
``SAMPLE`` labelled rows, those least by a hash of doc_id; a fifth of them set
the temperature that calibrates its probabilities.

Defined cases: null and empty texts are the average of nothing (zeros) and get
a score as any other; labels that are null are not used; a doc_id with several
labels takes the largest; with labels of one kind only, or none, every score is
that kind's share (half, if none); equal scores are no matter, as rows are not
ranked; repeated rows count; texts of any length are read whole, some megabyte
at a time or one text; an empty table gives no rows; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import doc_text, map_arrow, merged_batches

BUCKETS = 1 << 13
DIM = 64
MARKS = 4
SAMPLE = 6000
SHARDS = 64
STEP_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: 0 blank, 1 letter, 2 digit, other signs are classes of their own
_CLASS = np.array([0 if c <= 32 else 1 if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 if 48 <= c <= 57 else c + 128 for c in range(256)], np.int16)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_up = _down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        _up, _down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, p)])) for p in (_P, _P_INV))
    return _up, _down


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unit (a word's shape follows the word), and each text's number of units."""
    parts = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    b = np.frombuffer(b"".join(parts), np.uint8)
    kind = _CLASS[b]
    begin = np.nonzero((kind != 0) & (kind != np.concatenate([[0], kind[:-1]])))[0]
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    end = np.nonzero((kind != 0) & (kind != np.concatenate([kind[1:], [0]])))[0] + 1
    up, down = _powers(len(b) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[b] + np.uint64(1)) * up[: len(b)])])
    code = (prefix[end] - prefix[begin]) * down[begin]
    uppers = np.concatenate([[0], np.cumsum(_UPPER[b])])
    size, caps = end - begin, uppers[end] - uppers[begin]
    word = kind[begin] == 1
    # digits count by length only, signs by kind and length up to 8
    code = np.where(kind[begin] == 2, np.uint64(7) + np.minimum(size, 32).astype(np.uint64), code)
    code = np.where(kind[begin] > 2, kind[begin].astype(np.uint64) * np.uint64(16) + np.minimum(size, 8).astype(np.uint64) + np.uint64(1000), code)
    case = np.where(caps == 0, 0, np.where(caps == size, 1, np.where((caps == 1) & _UPPER[b[begin]], 2, 3)))
    shape = np.uint64(1 << 40) + (case * 64 + np.minimum(size, 24)).astype(np.uint64)
    again = np.concatenate([[False], (code[1:] == code[:-1]) & word[1:] & word[:-1]])
    shape = np.where(again, np.uint64(1 << 41), shape)  # a word said twice has a shape of its own
    at = np.arange(len(begin)) + np.concatenate([[0], np.cumsum(word)[:-1]])
    out = np.empty(len(begin) + int(word.sum()), np.uint64)
    out[at] = code
    out[at[word] + 1] = shape[word]
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    text = np.searchsorted(first, begin, side="right") - 1
    return (out >> np.uint64(51)).astype(np.int32), np.bincount(text, 1 + word, minlength=len(texts)).astype(np.int64)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, MARKS)), rng.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, MARKS))


def _steps(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > STEP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def context_sums(texts: list[str | None], total: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Adds each unit's neighbours' index vectors to ``total`` (BUCKETS x DIM)."""
    flat = total.reshape(-1)
    for some in _steps(texts):
        u, n = units(some)
        text = np.repeat(np.arange(len(n)), n)
        pair = np.zeros(0, np.int64)
        for far in (1, 2):
            same = text[:-far] == text[far:]
            a, b = u[:-far][same].astype(np.int64), u[far:][same].astype(np.int64)
            pair = np.concatenate([pair, a * BUCKETS + b, b * BUCKETS + a])
        pair, times = np.unique(pair, return_counts=True)  # far fewer than pairs
        row, other = pair // BUCKETS, pair % BUCKETS
        for k in range(MARKS):
            flat += np.bincount(row * DIM + place[other, k], times * sign[other, k], minlength=len(flat))


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Context sums over all of ``docs``; BUCKETS x DIM."""
    rows = BUCKETS // SHARDS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros((BUCKETS, DIM))
        for batch in batches:
            context_sums(batch.column("text").to_pylist(), total, place, sign)
        yield pa.RecordBatch.from_pydict({"shard": pa.array(np.arange(SHARDS)), "part": pa.array([total[k * rows : (k + 1) * rows].astype(np.int32).tobytes() for k in range(SHARDS)], pa.binary())})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, "<i4" if len(part) == rows * DIM * 4 else "<i8").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"shard": pa.array(list(sums), pa.int64()), "part": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    parts = doc_text(docs).select("text").mapInArrow(add, "shard long, part binary")
    out = np.zeros((SHARDS, rows * DIM))
    for r in parts.repartition(SHARDS, "shard").mapInArrow(unite, "shard long, part binary").collect():  # BUCKETS x DIM numbers
        out[r.shard] = np.frombuffer(r.part, "<i8")
    return out.reshape(BUCKETS, DIM)


@dataclass
class QualityModel:
    vectors: np.ndarray  # BUCKETS x DIM
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        return pooled(self.vectors, texts)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -500, 500)))


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Context and index vectors of length one, added."""
    place, sign = index_vectors()
    index = np.zeros((BUCKETS, DIM))
    np.add.at(index, (np.arange(BUCKETS)[:, None], place), sign)
    one = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return (one(sums) + one(index)).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    out = []
    for some in _steps(texts):
        u, n = units(some)
        text = np.repeat(np.arange(len(n)), n)
        key, times = np.unique(text * np.int64(BUCKETS) + u, return_counts=True)
        got = np.zeros((len(some), DIM))
        row = key // BUCKETS
        if len(key):
            at = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
            got[row[at]] = np.add.reduceat(vectors[key % BUCKETS] * times[:, None].astype(np.float32), at, axis=0)
        out.append(got / np.maximum(n, 1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, DIM))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 200, rate: float = 0.01, seed: int = 3) -> QualityModel:
    """``x``: pooled vectors, ``y``: 0 or 1, in an order that does not depend on the cluster."""
    zeros = np.zeros(DIM)
    share = float(y.mean()) if len(y) else 0.5
    empty = QualityModel(vectors, zeros, zeros + 1, np.zeros((DIM, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0, share)
    if len(set(y.tolist())) < 2:
        return empty
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cal, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-6
    z = (x - mean) / scale
    p = [rng.standard_normal((DIM, hidden)) / np.sqrt(DIM), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, epochs + 1):
        h = np.tanh(z[train] @ p[0] + p[1])
        d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[train]) / len(train)
        back = d[:, None] * p[2] * (1 - h * h)
        grads = [z[train].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
        for q, g, a, b in zip(p, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    model = QualityModel(vectors, mean, scale, *p[:3], float(p[3][0]), 1.0)
    if len(set(y[cal].tolist())) == 2:
        raw = model.logits(x[cal])
        loss = lambda t: np.mean(np.logaddexp(0, np.where(y[cal] == 1, -raw, raw) / t))
        model.temperature = float(min(np.geomspace(1, 20, 61), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE) -> QualityModel:
    """Vectors from all of ``docs``; the network from the labelled rows that ``use`` marks, ``sample`` at most."""
    vectors = unit_vectors(corpus_vectors(docs))
    marked = labels.where(use & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("y"))
    picked = marked.groupBy("l_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = doc_text(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))  # `sample` rows
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(shared.value, batch.column("text").to_pylist())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), DIM).cast(pa.list_(pa.float64()))})

    got = map_arrow(rows.select("doc_id", "text", "y"), pool, "doc_id long, y int, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    return fit(vectors, np.array([r.x for r in got]).reshape(-1, DIM), np.array([int(r.y > 0) for r in got]))


def score(docs: DataFrame, model: QualityModel, cut: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 where score >= cut)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in merged_batches(batches, 8 << 20):
            p = shared.value.scores(t.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": t.column("doc_id").combine_chunks(), "score": pa.array(p), "predicted": pa.array((p >= cut).astype(np.int32))})

    return doc_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
