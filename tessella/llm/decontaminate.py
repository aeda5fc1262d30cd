"""Benchmark decontamination with a generalised suffix automaton.

Test items, normalised to words, are the strings of one suffix automaton over
word numbers. A document's words stream through it; the state and the longest
matching length at each word tell which windows of ``window`` words (or whole
shorter items) end there. Only runs of words that the benchmark knows, as long
as its shortest window, can hold a match: others are skipped unread.

Items of one text are one string. Strings are dealt by hash into shards of about
``SHARD_WORDS`` words (long ones in pieces that overlap by a window less one
word, so that no window is lost). A shard's automaton is built in one executor,
as flat arrays of at most two states a word, and broadcast; the driver holds its
bytes, one shard at a time. With one shard, documents are read once. With
several, each shard's hits are written by a 128-bit hash of the text (hits are a
function of the text), united, and joined with the documents; the rows are the
same for any number of shards.

Defined cases: null and empty texts have no words and are not contaminated; an
item without words has no window; repeated items each count, a null item_id as
empty text; repeated documents are rows of their own; texts of any length are
one task's Python object; an empty benchmark leaves all as it is; columns named
n_words, spans or items are replaced by ``scan``, others may have any name and
type.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, map_arrow, shielded, sliced, without

#: bytes: letters of any case and digits stay (A-Z lowered), everything else ASCII parts words
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
SHARD_WORDS = 1_000_000
PIECE_WORDS = 100_000
CHUNK = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of word sequences, with the items of each window's state.

    A state's first transition lies in flat arrays, further ones in ``more``; likewise the window that ends in it.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = self.shortest = window
        self.vocabulary: dict[bytes, int] = {}
        self.char, self.to, self.link, self.length = (array("i", [x]) for x in (-1, -1, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        self.ids = [i for i, w in items if w]
        coded = [array("i", [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]) for _, w in items if w]
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            self.shortest = min(self.shortest, len(seq))
        self.size, self.item = (array("i", [x]) * len(self.link) for x in (0, -1))
        self.others: dict[int, dict[int, set[int]]] = {}
        for k, seq in enumerate(coded):
            state, size = 0, min(window, len(seq))
            matched = 0
            for n, c in enumerate(seq, 1):
                state, matched = self.step(state, matched, c)
                if n >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    # the window's items belong to the one state whose range of lengths holds it
                    if not self.size[at]:
                        self.size[at], self.item[at] = size, k
                    elif (self.size[at], self.item[at]) != (size, k):
                        self.others.setdefault(at, {}).setdefault(size, set()).add(k)
        #: the next state on the way up, itself included, that ends a window; -1 if none
        self.up = array("i", [-1]) * len(self.link)
        for s in np.argsort(np.asarray(self.length), kind="stable")[1:].tolist():
            self.up[s] = s if self.size[s] else self.up[self.link[s]]

    def _go(self, state: int, c: int) -> int:
        if self.char[state] == c:
            return self.to[state]
        further = self.more.get(state)
        return -1 if further is None else further.get(c, -1)

    def _put(self, state: int, c: int, to: int) -> None:
        if self.char[state] in (-1, c):
            self.char[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, length: int, link: int) -> int:
        for a, x in ((self.char, -1), (self.to, -1), (self.link, link), (self.length, length)):
            a.append(x)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        length = self.length
        if (q := self._go(last, c)) >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, 0)
        p = last
        while p != -1 and (q := self._go(p, c)) < 0:
            self._put(p, c, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q])
        self.char[new], self.to[new] = self.char[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p != -1 and self._go(p, c) == q:
            self._put(p, c, new)
            p = self.link[p]
        return new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        while (to := self._go(state, c)) < 0:
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
        return to, matched + 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Half-open word ranges inside occurring windows, united, and the items met."""
        if len(words) < self.shortest or not self.ids:
            return [], set()
        codes = np.fromiter(map(self.vocabulary.get, words, _minus), np.int64, len(words))
        known = np.concatenate([[False], codes >= 0, [False]])
        edges = np.nonzero(known[1:] != known[:-1])[0]
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        step, link, up, sizes, item, others, shortest = self.step, self.link, self.up, self.size, self.item, self.others, self.shortest
        char, to = self.char, self.to

        def hit(size: int, end: int) -> None:
            lo = end - size
            while spans and lo <= spans[-1][1]:
                lo = min(lo, spans.pop()[0])
            spans.append((lo, end))

        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                if char[state] == c:
                    state, matched = to[state], matched + 1
                else:
                    state, matched = step(state, matched, c)
                if matched >= shortest:
                    at = up[state]
                    while at > 0:
                        if sizes[at] <= matched:
                            items.add(item[at])
                            hit(sizes[at], i)
                        for size, who in others.get(at, {}).items():
                            if size <= matched:
                                items |= who
                                hit(size, i)
                        at = up[link[at]]
        return spans, items


class _Minus:
    """An endless -1, the default of map(dict.get, words, ...)."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_minus = _Minus()


ITEM = "key binary, ids array<string>, words binary, n long"


def strings(benchmark: DataFrame, window: int, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(key, ids, words, n): the words of every text of the items, in pieces where it is long, and the items that have it."""
    one = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    one = one.where("text is not null").groupBy("text").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    step = max(1, piece_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text, ids in zip(batch.column("text").to_pylist(), batch.column("ids").to_pylist()):
                w, key = words_of(text), hashlib.md5(text.encode("utf-8", "replace")).digest()
                for k in range(0, max(1, len(w) - window + 1), step) if w else ():
                    part = w[k : k + step + window - 1]
                    for o, x in zip(out, (key, ids, b" ".join(part), len(part))):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.binary(), pa.list_(pa.string()), pa.binary(), pa.int64()))], ["key", "ids", "words", "n"])

    return one.mapInArrow(run, ITEM)


def automata(benchmark: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> Iterator[bytes]:
    """The pickled automaton of each shard, built in an executor; at least one. The first item is their number."""
    pieces = checkpointed(strings(benchmark, window, min(PIECE_WORDS, max(1, shard_words))))
    n = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / shard_words))
    yield n

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in batches:
            for r in batch.to_pylist():
                items.append(((r["key"], r["ids"]), r["words"].split(b" ")))
        made = pickle.dumps(Automaton(items, window), pickle.HIGHEST_PROTOCOL)
        parts = [made[k : k + CHUNK] for k in range(0, len(made), CHUNK)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(parts)), pa.int32()), "part": pa.array(parts, pa.binary())})

    for k in range(n):
        shard = pieces.where(F.pmod(F.xxhash64("key", "words"), F.lit(n)) == k).coalesce(1)  # shard_words words
        yield b"".join(r.part for r in sorted(shard.mapInArrow(build, "at int, part binary").collect(), key=lambda r: r.at))


class _Shared:
    """A broadcast automaton; a worker unpickles it once and keeps no other."""

    held: tuple[str, Automaton] | None = None

    def __init__(self, broadcast):
        self.broadcast, self.key = broadcast, uuid.uuid4().hex

    def automaton(self) -> Automaton:
        if _Shared.held is None or _Shared.held[0] != self.key:
            _Shared.held = None
            _Shared.held = (self.key, pickle.loads(self.broadcast.value))
        return _Shared.held[1]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _found(n: list[int], spans: list, items: list) -> dict[str, pa.Array]:
    return {"n_words": pa.array(n, pa.int64()), "spans": pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], _SPANS), "items": pa.array(items, pa.list_(pa.string()))}


def _listed(met: dict[bytes, list[str]]) -> list[str]:
    return sorted(i for ids in met.values() for i in ids)


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, text: bool, cut: bool = False) -> DataFrame:
    """``docs`` with FOUND; with ``text`` the text stays, with ``cut`` without the spans hit."""
    made = automata(benchmark, window, shard_words)
    several = next(made) > 1
    session = docs.sparkSession.sparkContext
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text" or text]
    names = [c for c in docs.columns if c != "text" or text]

    def answer(batch: pa.RecordBatch, find) -> pa.RecordBatch:
        n, spans, items, texts = [], [], [], []
        for k, t in enumerate(batch.column("text").to_pylist()):
            w = words_of(t)
            s, met = find(k, w)
            n.append(len(w))
            spans.append(s)
            items.append(_listed(met))
            texts.append(cut_spans(t, s) if s and cut else t)
        cols = {c: batch.column(c) for c in names}
        if cut:
            cols["text"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_pydict(cols | _found(n, spans, items))

    if not several:
        shared = _Shared(session.broadcast(next(made)))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            a = shared.automaton()

            def find(_: int, words: list[bytes]):
                s, met = a.scan(words)
                return s, dict(a.ids[j] for j in met)

            return answer(batch, find)

        return map_arrow(docs, run, ", ".join([*fields, FOUND]))

    keys = ["_k1", "_k2"]
    keyed = docs.withColumn("_k1", F.xxhash64(F.lit(1), "text")).withColumn("_k2", F.xxhash64(F.lit(2), "text"))
    hit = [checkpointed(_hits(keyed.select(*keys, "text"), session.broadcast(a)).dropDuplicates(keys)) for a in made]
    united = reduce(DataFrame.unionByName, hit).groupBy(*keys).agg(F.collect_list("hit").alias("_hits"))

    def unite(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = batch.column("_hits").to_pylist()

        def find(k: int, _: list[bytes]):
            pairs, met = [], {}
            for h in parts[k] or ():
                pairs += [(x["start"], x["end"]) for x in h["spans"]]
                met |= {i["key"]: i["ids"] for i in h["items"]}
            out: list[tuple[int, int]] = []
            for a, b in sorted(pairs):
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], max(b, out[-1][1]))
                else:
                    out.append((a, b))
            return out, met

        return answer(batch, find)

    return map_arrow(keyed.join(united, keys, "left"), unite, ", ".join([*fields, FOUND]))


HIT = "struct<spans:array<struct<start:int,end:int>>,items:array<struct<key:binary,ids:array<string>>>>"


def _hits(rows: DataFrame, broadcast) -> DataFrame:
    """(_k1, _k2, hit) of the texts that a shard hits."""
    shared = _Shared(broadcast)
    kind = pa.struct([("spans", _SPANS), ("items", pa.list_(pa.struct([("key", pa.binary()), ("ids", pa.list_(pa.string()))])))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = shared.automaton()
        at, out = [], []
        for k, t in enumerate(batch.column("text").to_pylist()):
            s, met = a.scan(words_of(t))
            if s:
                at.append(k)
                out.append({"spans": [{"start": x, "end": y} for x, y in s], "items": [{"key": a.ids[j][0], "ids": a.ids[j][1]} for j in met]})
        some = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([some.column("_k1"), some.column("_k2"), pa.array(out, kind)], ["_k1", "_k2", "hit"])

    return map_arrow(rows, run, f"_k1 long, _k2 long, hit {HIT}")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS, text: bool = True) -> DataFrame:
    """The columns of ``docs`` with n_words, spans (word ranges hit) and items (ids met, sorted as strings)."""
    return _scan(without(docs, ("n_words", "spans", "items")), benchmark, window, shard_words, text)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more are hit)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = scan(rows, benchmark, window, shard_words, text=False).withColumn("n_hit", hits)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what lies between them."""
    data = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return (b"".join(out) + data[last:]).decode("utf-8", "replace")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, drop_share: float = 0.05, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without documents that have ``drop_share`` of their words hit or more; others lose the spans hit."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    hidden, back = shielded(docs, ("text",))
    hit = _scan(hidden, benchmark, window, shard_words, True, cut=True).withColumn("_hit", hits)
    return back(hit.where(~((F.col("_hit") > 0) & (F.col("_hit") >= F.col("n_words") * F.lit(drop_share)))))
