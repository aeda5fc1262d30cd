"""Line dedup by content-defined chunks.

A rolling hash over the hashes of ``WIDTH`` consecutive lines ends a chunk
where it is a multiple of ``divisor``, so an inserted or lost line moves only
the boundaries next to it. Chunks of at least two lines and ``chunk_words``
words are candidates. Boundaries fall where they will, so a shared passage may
lie in a chunk with lines of its neighbourhood; therefore the shortest runs of
lines with over ``passage_words`` words, from each line on and back from each
line, are candidates too: every shared passage of whole lines with more words
is made up of such runs.

Candidates meet by 64-bit hash first, without text. Those met more than once
are then compared by their bytes, as grouping keys, and all but the first
occurrence (by doc_id, then row, then line) lose their lines. Hashes that hold
more than one in ``HOT`` of all candidates, so at most ``HOT`` hashes, are
broadcast, and their occurrences never meet in one task.

Defined cases: null stays null and empty stays empty; a text that only repeats
others becomes empty, its row stays; blank lines count as lines; rows that
repeat both doc_id and text are one document, known by 128 bits of hash; a null
doc_id comes first; where occurrences overlap within a text, all lines from the
second on go; repeats of fewer than ``chunk_words`` words, or in no chunk and of
at most ``passage_words``, stay; a text of any length is one task's Python
object; an empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, shielded, sliced
from tessella.sources.scratch import written

WIDTH = 2
DIVISOR = 4
CHUNK_WORDS = 20
PASSAGE_WORDS = 50
STEP = 500
HOT = 10_000
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        out = np.multiply.accumulate(out)
    return out


def candidates_of(lines: list[bytes], divisor: int = DIVISOR, chunk_words: int = CHUNK_WORDS, passage_words: int = PASSAGE_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, hash) of a text's candidate runs; ``end`` exclusive, each run once."""
    n = len(lines)
    words = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
    if words[-1] < min(chunk_words, passage_words + 1):
        return []
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    up, down = _powers(_P, n), _powers(_P_INV, n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
    # chunks
    roll = hashes.copy()
    for k in range(1, WIDTH):
        roll[k:] += hashes[:-k] * np.uint64(pow(_P, k, 1 << 64))
    roll ^= roll >> np.uint64(29)
    ends = np.nonzero(roll % np.uint64(divisor) == 0)[0] + 1
    ends = np.unique(np.append(ends, n))
    starts = np.concatenate([[0], ends[:-1]])
    long = (ends - starts >= 2) & (words[ends] - words[starts] >= chunk_words)
    s, e = [starts[long]], [ends[long]]
    # shortest runs of over passage_words words, forwards and backwards
    at = np.arange(n)
    ahead = np.searchsorted(words, words[at] + passage_words, side="right")
    fits = ahead <= n
    s.append(at[fits])
    e.append(ahead[fits])
    back = np.searchsorted(words, words[at + 1] - passage_words, side="left") - 1
    fits = back >= 0
    s.append(back[fits])
    e.append(at[fits] + 1)
    s, e = np.concatenate(s), np.concatenate(e)
    run = np.unique(s * (n + 1) + e)
    s, e = run // (n + 1), run % (n + 1)
    mixed = (prefix[e] - prefix[s]) * down[s] ^ (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return list(zip(s.tolist(), e.tolist(), mixed.view(np.int64).tolist()))


def _split(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").split(b"\n")


KEY = ["_ld_k1", "_ld_k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    of = [F.col("doc_id").cast("long"), F.col("text")]
    return docs.withColumn(KEY[0], F.xxhash64(F.lit(1), *of)).withColumn(KEY[1], F.xxhash64(F.lit(2), *of))


def dedup(docs: DataFrame, divisor: int = DIVISOR, chunk_words: int = CHUNK_WORDS, passage_words: int = PASSAGE_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``; with ``counts`` also n_lines, n_removed (lines)."""
    hidden, back = shielded(docs, ("doc_id", "text"))
    keyed = _keyed(hidden)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, STEP):
            runs = [candidates_of(_split(t), divisor, chunk_words, passage_words) for t in batch.column("text").to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(runs)), [len(r) for r in runs]))
            flat = [pa.array([x[k] for r in runs for x in r], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in KEY), *flat], [*KEY, "s", "e", "h"])

    found = checkpointed(keyed.select(*KEY, "text").mapInArrow(find, "_ld_k1 long, _ld_k2 long, s int, e int, h long"))
    again = checkpointed(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    many = (again.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(again.where(F.col("n") > many).select(F.col("h").alias("h2")))  # fewer than HOT rows
    rest = again.where(F.col("n") <= many).select(F.col("h").alias("h2"))
    marks = F.struct("s", "e", "h")
    same = F.col("h") == F.col("h2")
    met = found.join(hot, same).unionByName(found.join(hot, same, "left_anti").join(rest, same))
    runs = met.groupBy(*KEY).agg(F.collect_set(marks).alias("_ld_runs"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, STEP):
            out: dict[str, list] = {c: [] for c in ("h", "bytes", "digest", "doc_id", *KEY, "s", "e")}
            cols = [batch.column(c).to_pylist() for c in ("doc_id", *KEY, "text", "_ld_runs")]
            for doc_id, k1, k2, text, marks in zip(*cols):
                lines = _split(text)
                for m in marks:
                    run = b"\n".join(lines[m["s"] : m["e"]])
                    for c, v in zip(out, (m["h"], run, hashlib.md5(run).digest(), doc_id, k1, k2, m["s"], m["e"])):
                        out[c].append(v)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    # written by column: bytes that repeat are stored once, and read once
    occurrences = written(keyed.join(runs, KEY).mapInArrow(texts, "h long, bytes binary, digest binary, doc_id long, _ld_k1 long, _ld_k2 long, s int, e int"))
    place = F.struct("doc_id", *KEY, "s")
    first = occurrences.groupBy("h", "bytes").agg(F.min(place).alias("first"), F.min("digest").alias("d2"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = checkpointed(first.select(F.col("h").alias("h3"), "d2", "first", "n"))
    # bytes made the groups; a run finds its group by its digests, so that text is not shuffled again
    places = occurrences.drop("bytes")
    of_group = (F.col("h") == F.col("h3")) & (F.col("digest") == F.col("d2"))
    many = (first.agg(F.sum("n")).first()[0] or 0) / HOT
    large = F.broadcast(first.where(F.col("n") > many))  # fewer than HOT rows
    later = places.join(large, of_group).unionByName(places.join(large, of_group, "left_anti").join(first.where(F.col("n") <= many), of_group))
    cuts = later.where(~place.eqNullSafe(F.col("first"))).groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("_ld_cuts"))
    names_out = list(hidden.columns)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in hidden.schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, STEP):
            text, removed, total = [], [], []
            for t, marks in zip(batch.column("text").to_pylist(), batch.column("_ld_cuts").to_pylist()):
                lines = _split(t) if marks or counts else []
                gone: set[int] = set()
                for m in marks or ():
                    gone.update(range(m["s"], m["e"]))
                text.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode("utf-8", "replace") if gone else t)
                removed.append(len(gone))
                total.append(len(lines))
            cols = [pa.array(text, pa.string()) if c == "text" else batch.column(c) for c in names_out]
            names = names_out
            if counts:
                cols, names = [*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(fields) + (", n_lines long, n_removed long" if counts else "")
    out = keyed.join(cuts, KEY, "left").mapInArrow(cut, schema)
    return out.toDF(*docs.columns, "n_lines", "n_removed") if counts else back(out)
