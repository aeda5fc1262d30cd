"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one node. Two fingerprints within ``radius`` = 2 bits
agree in at least two of four 16-bit blocks, so a node lies under six keys of
two blocks each; under a key, nodes are dealt into tiles by the population count
of all bits, and a tile is compared with itself and with those tiles whose count
is at most the radius higher: tile pairs further apart are skipped, and no pair
within the radius is missed. Tiles of more than ``TILE`` residents are dealt
into blocks, each of which sees all visitors. Comparison is numpy exclusive-or
and bit counts; what leaves a task is a spanning forest of its links, never all
pairs, and components are joined by star rounds over edges.

Fingerprints themselves are the nodes; a group's smallest doc_id is found when
the groups are known, so ids may be any longs. Rows meet their group in joins
with one row for each fingerprint and no aggregation above, whose large keys
adaptive execution splits.

Defined cases: null, empty and blank texts have fingerprint zero and link to
each other; texts under three words have one shingle; a null doc_id takes part
in links but is no one's smallest id, and a group without any id has a null
component_id; rows that repeat both doc_id and text are one document, of which
``keep_one`` keeps any row; of a group it keeps the smallest doc_id (null last,
then by a hash of the text); texts of any length are one task's Python object,
their hashes numpy arrays; an empty table gives no rows; other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, doc_text, map_arrow, shielded
from tessella.llm.components import components, forest

SHINGLE = 3
SEED = 42
TILE = 4096
SMALL = 32
_LANES = np.uint64(0x0001000100010001)
_SEGMENT = 60_000


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of every shingle, repeats included; of the whole sequence where it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Bit b is set where it is in over half of a text's hashes; uint64."""
    hashes = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if not len(flat):
        return out
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.nonzero(at % _SEGMENT == 0)[0]  # 16-bit lanes hold a segment's counts
    seg_owner = owner[first]
    for k in range(16):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, first)
        for j in range(4):
            count = np.bincount(seg_owner, (lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF), minlength=len(texts))
            out |= (2 * count > sizes).astype(np.uint64) << np.uint64(k + 16 * j)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long."""
    return _printed(doc_text(docs))


def _printed(rows: DataFrame) -> DataFrame:
    """``rows`` (all of type long, but for text) with fp in place of text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [fingerprints_of(batch.column("text").slice(k, 500).to_pylist()) for k in range(0, batch.num_rows, 500)]
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"fp": pa.array(np.concatenate(got).view(np.int64))})

    return map_arrow(rows, run, ", ".join(f"{c} long" for c in kept) + ", fp long")


def tile_links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one tile (runs of equal ``keys``) within the radius, at least one of them resident."""
    left, right = [], []
    edges = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))[0]
    sizes = np.diff(edges)
    if (most := min(SMALL, int(sizes.max()))) > 1:
        small = np.repeat(sizes <= SMALL, sizes)
        for shift in range(1, most):
            i = np.nonzero((keys[:-shift] == keys[shift:]) & small[:-shift] & (home[:-shift] | home[shift:]))[0]
            i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= radius]
            left.append(i)
            right.append(i + shift)
    for a, n in zip(edges[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        here = np.arange(a, a + n)
        res = here[home[here]]
        for k in range(0, len(res), 512):
            for m in range(0, n, TILE):
                near = np.bitwise_count(fps[res[k : k + 512], None] ^ fps[here[m : m + TILE]][None]) <= radius
                i, j = np.nonzero(near)
                i, j = res[k + i], here[m + j]
                if len(i):
                    i, j = forest(i, j)
                left.append(i)
                right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between fingerprints ``fp`` within the radius; a spanning forest of each task's."""
    if radius != 2:
        raise ValueError("the block scheme is exact for a radius of 2")
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = [F.shiftleft(block(a), 16).bitwiseOR(block(b)) + F.lit(n << 40) for n, (a, b) in enumerate(combinations(range(4), 2))]
    spread = nodes.select("fp", F.bit_count("fp").cast("long").alias("pop"), F.explode(F.array(*keys)).alias("key"))
    # resident in the tile of its own count, visitor in those of counts up to the radius below
    spread = spread.select("fp", "key", "pop", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("below"))
    tile = F.col("key") * 128 + F.col("pop") - F.col("below") + radius
    spread = spread.select("fp", tile.alias("tile"), (F.col("below") == 0).alias("home"))
    held = spread.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    held = held.select(F.col("tile").alias("t"), F.ceil(F.col("homes") / TILE).cast("int").alias("blocks"))
    kept = spread.join(held, F.col("tile") == F.col("t")).select("fp", "tile", "home", "blocks")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    kept = kept.select("fp", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "home", own.alias("own"))
    kept = kept.select("fp", "tile", "block", (F.col("home") & (F.col("own") == F.col("block"))).alias("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch, last in _flagged(batches):
            cols = [np.asarray(batch.column(c)) for c in ("tile", "block", "fp", "home")]
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            t, b = cols[0], cols[1]
            key = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (b[1:] != b[:-1])]))
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            rest = [c[cut:] for c in cols]
            if not cut:
                continue
            i, j = tile_links(key[:cut], cols[2][:cut].view(np.uint64), cols[3][:cut].astype(bool), radius)
            if len(i):
                u, v = forest(cols[2][i], cols[2][j])
                yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    tiles = kept.repartition("tile", "block").sortWithinPartitions("tile", "block")
    return tiles.mapInArrow(compare, "u long, v long")


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield before, False
            before = batch
    if before is not None:
        yield before, True


def _groups(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of every fingerprint; a component is named by one of its fingerprints."""
    nodes = checkpointed(prints.select("fp").distinct())
    found = components(links(nodes, radius))
    return nodes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    prints = checkpointed(fingerprints(docs))
    groups = _groups(prints, radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups, F.col("fp") == F.col("f")).groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).select("f", "component_id")
    out = prints.join(named, F.col("fp") == F.col("f"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """``docs`` with one document of every component."""
    hidden, back = shielded(docs, ("doc_id", "text"))
    names = hidden.columns
    of = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    keyed = hidden.withColumn("_k1", F.xxhash64(F.lit(1), *of)).withColumn("_k2", F.xxhash64(F.lit(2), *of))
    prints = checkpointed(_printed(keyed.select(of[0].alias("doc_id"), "_k1", "_k2", of[1].alias("text"))).distinct())
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")).alias("w"))
    least = least.join(_groups(prints, radius), F.col("fp") == F.col("f")).groupBy("component").agg(F.min("w").alias("w"))
    stay = least.select(F.col("w._k1").alias("_k1"), F.col("w._k2").alias("_k2"))
    # equal rows are one before they are dealt out; the join then finds them where they are
    return back(keyed.dropDuplicates(["_k1", "_k2"]).join(stay, ["_k1", "_k2"], "left_semi").select(*names))
