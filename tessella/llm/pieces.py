"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across (before a run
of word marks, around line ends), so that each cut word can be encoded alone.
The distinct words that a worker has not met lie in flat numpy symbol arrays,
cut once more between characters that no piece holds side by side: a round looks
up the rank of every adjacent pair, takes the minimum per segment, merges all
leftmost occurrences of it at once and compacts, until no segment has a pair
left. A segment of more than ``LONG`` characters would need as many rounds as it
has ranks; its pairs are merged off a heap in the same order, in time that grows
with its length alone. The ids equal those of the library's own encoder.

Defined cases: null and empty texts give the begin and end ids alone; control
strings in a text are ordinary text; characters without a piece become byte
pieces; texts and words of any length are encoded whole, a text being one task's
Python object; repeated rows give repeated rows; an empty table gives no rows;
only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import doc_text, sliced

MARK = "▁"
NONE = np.int64(1 << 40)
STEP = 500
LONG = 400
LEARN = 8_000  # words that are merged in one set of flat arrays
CACHE_WORDS = 300_000  # words a worker remembers; beyond, only those of its last batch stay


class PieceModel:
    """The vocabulary of a BPE model, read from the library; no training."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.scores = [sp.get_score(i) for i in range(size)]
        self.control = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.byte = [sp.is_byte(i) for i in range(size)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.dummy_prefix = bool(sp.encode("a", out_type=str)[0].startswith(MARK))

    @property
    def key(self) -> str:
        return hashlib.sha256("\n".join(self.pieces).encode()).hexdigest()


class Codec:
    """Numpy tables of a PieceModel, made once in each worker."""

    def __init__(self, model: PieceModel):
        self.model = model
        pieces = {p: i for i, p in enumerate(model.pieces) if not (model.control[i] or model.byte[i])}
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        many = sorted((i for p, i in pieces.items() if len(p) > 1), key=lambda i: -model.scores[i])
        rank = {i: k for k, i in enumerate(many)}
        # equal scores share a rank: the leftmost goes first, as in the library
        for k in range(1, len(many)):
            if model.scores[many[k]] == model.scores[many[k - 1]]:
                rank[many[k]] = rank[many[k - 1]]
        keys, ranks, made = [], [], []
        cautious = np.zeros(len(many) + 1, bool)
        seen: dict[int, int] = {}
        for i in many:
            p = model.pieces[i]
            seen[rank[i]] = seen.get(rank[i], 0) + 1
            for cut in range(1, len(p)):
                a, b = pieces.get(p[:cut]), pieces.get(p[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    ranks.append(rank[i])
                    made.append(i)
                for part in (a, b):  # merging `part` may give rise to a better pair: then only one merge a round
                    if part is not None and rank.get(part, -1) >= rank[i]:
                        cautious[rank[part]] = True
        for r, n in seen.items():
            cautious[r] |= n > 1
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        self.cautious = cautious
        long = [p for p in pieces if len(p) > 1]
        marks_lead = not any(MARK in p.lstrip(MARK) for p in long)
        lines_alone = not any("\n" in p for p in long)
        if marks_lead:
            self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lines_alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        else:
            self.cut = lambda text: [text] if text else []
        raw = []
        for i, p in enumerate(model.pieces):
            raw.append(b"" if model.control[i] else bytes([int(p[3:5], 16)]) if model.byte[i] else p.replace(MARK, " ").encode())
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_id = np.full(256, model.unk, np.int64)
        for i, p in enumerate(model.pieces):
            if model.byte[i]:
                self.byte_id[int(p[3:5], 16)] = i
        self.words: dict[str, tuple[bytes, bytes]] = {}
        #: characters that some piece holds side by side
        self.beside = np.unique(np.array([(ord(a) << 21) | ord(b) for p in long for a, b in zip(p, p[1:])], np.int64))
        self.table: dict[int, tuple[int, int]] = {}

    def _pairs(self, sym: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made piece of the pair that begins at each symbol."""
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        at = np.nonzero(same & (sym[:-1] >= 0) & (sym[1:] >= 0))[0]
        key = (sym[at] << 32) | sym[at + 1]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[k] == key
        at, k = at[hit], k[hit]
        rank[at], made[at] = self.ranks[k], self.made[k]
        return rank, made

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty words, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char_id[chars].astype(np.int64)
        sym[sym < 0] = -1 - chars[sym < 0].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lens)
        apart = np.concatenate([[False], owner[1:] != owner[:-1]])
        if len(self.beside):
            pair = (chars[:-1].astype(np.int64) << 21) | chars[1:]
            apart[1:] |= self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair
        word = np.cumsum(apart)  # of segments, from here on
        owner = owner[np.concatenate([[0], np.nonzero(apart)[0]])]
        done_sym, done_word = [], []
        sizes = np.bincount(word)
        for k in np.nonzero(sizes > LONG)[0].tolist():
            at = int(np.searchsorted(word, k))
            merged = self._merged(sym[at : at + sizes[k]])
            done_sym.append(merged)
            done_word.append(np.full(len(merged), k))
        if done_sym:
            short = sizes[word] <= LONG
            sym, word = sym[short], word[short]
        while len(sym):
            rank, made = self._pairs(sym, word[:-1] == word[1:])
            first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            sizes = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == NONE, sizes)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                left = ~over
                sym, word, rank, made = sym[left], word[left], rank[left], made[left]
                sizes, best = sizes[best != NONE], best[best != NONE]
                if not len(sym):
                    break
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            take = rank == np.repeat(best, sizes)
            at = np.arange(len(sym))
            begins = take & ~np.concatenate([[False], take[:-1]])
            run = np.maximum.accumulate(np.where(begins, at, 0))
            take &= (at - run) % 2 == 0
            if (one := self.cautious[best]).any():
                count = np.cumsum(take)
                before = np.repeat(count[first] - take[first], sizes)
                take &= ~np.repeat(one, sizes) | (count - before == 1)
            sym = np.where(take, made, sym)
            keep = ~np.concatenate([[False], take[:-1]])
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (sym < 0).any():
            sym, word = self._bytes(sym, word)
        return sym, np.bincount(owner[word], minlength=len(words))

    def _merged(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of one long segment, merged by rank and then from the left, off a heap."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        table, n = self.table, len(sym)
        rank, _ = self._pairs(sym, np.ones(n - 1, bool))
        at = np.nonzero(rank < NONE)[0]
        heap = ((rank[at] << 40) | at).tolist()
        heapq.heapify(heap)
        now, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        place = (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            i = top & place
            j = after[i]
            if gone[i] or j >= n:
                continue
            got = table.get((now[i] << 32) | now[j]) if now[i] >= 0 <= now[j] else None
            if got is None or got[0] != top >> 40:
                continue
            now[i], gone[j], after[i] = got[1], 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and now[a] >= 0 <= now[b] and (got := table.get((now[a] << 32) | now[b])):
                    heapq.heappush(heap, (got[0] << 40) | a)
        return np.array([x for x, g in zip(now, gone) if not g], np.int64)

    def _bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece as their UTF-8 bytes' pieces."""
        cp = np.where(sym < 0, -1 - sym, 0)
        n = np.where(sym < 0, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
        at = np.repeat(np.arange(len(sym)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        total, c = n[at], cp[at]
        tail = (c >> (6 * (total - 1 - k))) & 0x3F
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[total] | (c >> (6 * (total - 1)))
        byte = np.where(total == 1, c, np.where(k == 0, lead, 0x80 | tail))
        return np.where(sym[at] < 0, self.byte_id[np.minimum(byte, 255)], sym[at]), word[at]

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 bytes of all ids, and the length of each counted group."""
        n = self.raw_len[ids]
        at = np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ends = np.concatenate([[0], np.cumsum(n)])
        cum = np.concatenate([[0], np.cumsum(counts)])
        return self.raw[at].tobytes(), ends[cum[1:]] - ends[cum[:-1]]

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        ids, counts = self.encode_words(words)
        raw, lens = self.decode_flat(ids, counts)
        flat = ids.astype("<u4").tobytes()
        out, i, j = {}, 0, 0
        for w, n, m in zip(words, (counts * 4).tolist(), lens.tolist()):
            out[w] = (flat[i : i + n], raw[j : j + m])
            i, j = i + n, j + m
        return out

    def run(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian, begin and end included) and its decoded UTF-8."""
        cut = []
        for t in texts:
            t = (t or "").replace(" ", MARK)
            cut.append(self.cut(MARK + t if self.model.dummy_prefix and t else t))
        wanted = set().union(*cut)
        known = self.words
        got = {w: known[w] for w in wanted if w in known}
        new = [w for w in wanted if w not in got]
        fresh = {}
        for k in range(0, len(new), LEARN):
            fresh.update(self._learn(new[k : k + LEARN]))
        got.update(fresh)
        if len(known) + len(fresh) > CACHE_WORDS:
            self.words = got if len(got) <= CACHE_WORDS else {}
        else:
            known.update(fresh)
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.model.bos, self.model.eos))
        out = []
        for words in cut:
            found = [got[w] for w in words]
            raw = b"".join([x[1] for x in found])
            if self.model.dummy_prefix and raw[:1] == b" ":
                raw = raw[1:]
            out.append((begin + b"".join([x[0] for x in found]) + end, raw))
        return out


_models: dict[str, Codec] = {}


def codec(model: PieceModel) -> Codec:
    if model.key not in _models:
        _models[model.key] = Codec(model)
    return _models[model.key]


@cache
def default_model() -> PieceModel:
    import public_tokenizers

    return PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, model: PieceModel, texts: bool = True) -> DataFrame:
    """doc_id, ids array<int>, ids_sha256, decoded_sha256, and with ``texts`` the text decoded from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is the vocabulary's

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        got = codec(shared.value).run(rows.column("text").to_pylist())
        lens = np.fromiter((len(x[0]) // 4 for x in got), np.int64, len(got))
        cols = {
            "doc_id": rows.column("doc_id"),
            "n_tokens": pa.array(lens),
            "ids_sha256": pa.array([hashlib.sha256(x[0]).hexdigest() for x in got]),
            "decoded_sha256": pa.array([hashlib.sha256(x[1]).hexdigest() for x in got]),
        }
        if texts:
            flat = pa.array(np.frombuffer(b"".join(x[0] for x in got), "<u4").astype(np.int32))
            cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), flat)
            cols["decoded"] = pa.array([x[1].decode("utf-8", "replace") for x in got])
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(made, sliced(batches, STEP))  # few documents' words and ids are held at a time

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return doc_text(docs).mapInArrow(run, schema + (", ids array<int>, decoded string" if texts else ""))


def decode(df: DataFrame, model: PieceModel, column: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of the ids in ``column`` (null ids: empty)."""
    from pyspark.sql.functions import pandas_udf

    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("string")
    def back(ids):
        import pandas as pd

        c, out = codec(shared.value), []
        for x in ids:
            flat = np.asarray([] if x is None else x, np.int64)
            raw, _ = c.decode_flat(flat, np.array([len(flat)]))
            out.append((raw[1:] if c.model.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return df.withColumn("decoded", back(F.col(column)))
