"""Language-model scores: add-one unigrams and a gated recurrent network.

Token counts come from all training documents. The network reads words of a
vocabulary (the commonest, one end and one mark for all others) that grows with
the root of the number of distinct words, from ``VOCAB`` on; its output is
factored: a softmax over classes, then one over the words of the class. A word
outside the vocabulary costs the mark's probability times its add-one share of
the words outside, so that scores are probabilities of whole texts. It is
trained by truncated backpropagation in numpy: it starts from at most ``SAMPLE``
documents (those least by a hash of doc_id), then every partition goes on from
there over all its training documents, and the weights of the partitions are
averaged by tokens. Documents are scored complete: sorted by length, window by
window, with the state carried from one window to the next.

Counts of the ``HEAD`` commonest words, at most, are broadcast; tokens of other
words are joined with the table of counts, so every count is exact at any size.

Defined cases: null and empty texts are one end token; without training
documents all counts are zero; repeated rows are rows of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ROWS, checkpointed, doc_text, merged_batches, sliced

END = b"\n"
HEAD = 300_000
VOCAB = 1024
HIDDEN = 16
WINDOW = 1 << 15
ROWS_AT_ONCE = 1 << 13
SAMPLE = 600
BUFFER = 12 << 20
PASS = 1 << 18
STREAMS = 512
BLOCK = 4096
NAMES = ("embed", "recur", "out_class", "out_word")


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split() + [END]


def vocabulary(types: int) -> int:
    """Vocabulary size for so many distinct words: a square, so that there are as many classes as words of a class."""
    return (math.isqrt(max(VOCAB, 2 * math.isqrt(types)) - 1) + 1) ** 2


@dataclass
class Gru:
    """Parameters; ``embed`` already holds the input's share of the three gates."""

    embed: np.ndarray  # vocabulary x 3H: update, reset, candidate
    recur: np.ndarray  # H x 3H
    out_class: np.ndarray  # (H + 1) x classes, the last row a bias
    out_word: np.ndarray  # classes x (H + 1) x per class

    @classmethod
    def new(cls, seed: int = 5, vocab: int = VOCAB) -> Gru:
        rng = np.random.default_rng(seed)
        classes = math.isqrt(vocab)
        f = lambda *s: rng.standard_normal(s).astype(np.float32)
        return cls(0.3 * f(vocab, 3 * HIDDEN), f(HIDDEN, 3 * HIDDEN) / 4, 0.1 * f(HIDDEN + 1, classes), 0.1 * f(classes, HIDDEN + 1, vocab // classes))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in NAMES])

    def filled(self, flat: np.ndarray) -> Gru:
        """A network of this shape with the weights of ``flat``."""
        parts = np.split(flat.astype(np.float32), np.cumsum([getattr(self, k).size for k in NAMES])[:-1])
        return Gru(*(p.reshape(getattr(self, k).shape).copy() for p, k in zip(parts, NAMES)))

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from the input's share of the gates; then the gates: update and reset, candidate, its recurrent part."""
        g = h @ self.recur
        zr = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        gn = g[:, 2 * HIDDEN :]
        n = zr[:, HIDDEN:] * gn
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[:, :HIDDEN]
        new += n
        return new, zr, n, gn

    def log_probs(self, h: np.ndarray, target: np.ndarray, grad: Gru | None = None) -> np.ndarray:
        """Natural log-probability of each target after its state; with ``grad`` (of zeros), returns the states' gradient of the summed loss and sets the parameters'."""
        classes, per = self.out_word.shape[0], self.out_word.shape[2]
        kind = target // per
        order = np.argsort(kind.astype(np.int16) if classes < 1 << 15 else kind, kind="stable")  # each class's states side by side
        kind, word = kind[order], (target % per)[order]
        h1 = np.empty((len(h), HIDDEN + 1), np.float32)
        h1[:, :HIDDEN], h1[:, HIDDEN] = h[order], 1
        at = np.arange(len(h))
        edges = np.searchsorted(kind, np.arange(classes + 1)).tolist()
        met = [(c, slice(edges[c], edges[c + 1])) for c in range(classes) if edges[c] < edges[c + 1]]
        a, b = h1 @ self.out_class, np.empty((len(h), per), np.float32)
        for c, rows in met:
            np.matmul(h1[rows], self.out_word[c], out=b[rows])
        lp = 0
        for x, w, goal in ((a, self.out_class, kind), (b, self.out_word, word)):
            if np.abs(w).sum(-2).max() > 60:  # else exp cannot overflow
                x -= x.max(1, keepdims=True)
            pick = x[at, goal]
            np.exp(x, out=x)
            total = x @ np.ones(x.shape[1], np.float32)
            lp = lp + (pick - np.log(total))
            if grad is not None:
                x *= (1 / total)[:, None]
                x[at, goal] -= 1
        out = np.empty((len(h), HIDDEN) if grad is not None else len(h), np.float32)
        if grad is None:
            out[order] = lp
            return out
        np.matmul(h1.T, a, out=grad.out_class)
        dh, more = a @ self.out_class[:HIDDEN].T, np.empty_like(out)
        back = np.ascontiguousarray(self.out_word[:, :HIDDEN].transpose(0, 2, 1))
        for c, rows in met:
            np.matmul(h1[rows].T, b[rows], out=grad.out_word[c])
            np.matmul(b[rows], back[c], out=more[rows])
        dh += more
        out[order] = dh
        return out

    def score(self, docs: list[np.ndarray], first: int) -> np.ndarray:
        """log10 probability of each whole id sequence; ``first``: the id read before a text."""
        sizes = np.array([len(d) for d in docs], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.concatenate([docs[k] for k in order]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        total, h = np.zeros(len(docs)), np.zeros((len(docs), HIDDEN), np.float32)
        # a window has about as many words whether many texts are left or few, so that outputs are computed over enough rows
        t0 = 0
        while t0 < sizes[0]:
            n0 = int(np.searchsorted(-sizes, -t0, side="left"))
            t1 = min(int(sizes[0]), t0 + max(1, WINDOW // n0))
            states, goals, owners = [], [], []
            n = n0
            for t in range(t0, t1):
                while n and sizes[n - 1] <= t:
                    n -= 1
                where = at[:n] + t
                prev = flat[where - 1] if t else np.full(n, first)
                h[:n] = self.step(self.embed[prev], h[:n])[0]
                states.append(h[:n].copy())
                goals.append(flat[where])
                owners.append(n)
            state, goal = np.concatenate(states), np.concatenate(goals)
            lp = np.concatenate([self.log_probs(state[k : k + ROWS_AT_ONCE], goal[k : k + ROWS_AT_ONCE]) for k in range(0, len(goal), ROWS_AT_ONCE)]).astype(np.float64)
            who = np.concatenate([np.arange(n) for n in owners])
            total[:n0] += np.bincount(who, lp, minlength=n0)
            t0 = t1
        out = np.empty(len(docs))
        out[order] = total / np.log(10)
        return out

    def fit(self, docs: list[np.ndarray], first: int, epochs: int = 3, streams: int = 32, steps: int = 16, rate: float = 0.01) -> None:
        """Truncated backpropagation over parallel streams of the texts, Adam steps that grow smaller."""
        if docs:
            adam = Adam(self)
            for epoch in range(epochs):
                adam.read(docs, first, streams, steps, lambda done: rate * (1 - 0.9 * (epoch + done) / epochs))  # noqa: B023


class Adam:
    """Trains a network in place and keeps the moments from one set of texts to the next."""

    def __init__(self, gru: Gru) -> None:
        self.gru, self.count = gru, 0
        self.m, self.v = ({k: np.zeros_like(getattr(gru, k)) for k in NAMES} for _ in range(2))

    def read(self, docs: list[np.ndarray], first: int, streams: int, steps: int, rate: Callable[[float], float]) -> None:
        """Once over all words of the texts; ``rate`` of the share that is done."""
        gru = self.gru
        flat = np.concatenate([np.array([first], np.int32), *docs])
        n = len(flat) - 1
        streams = max(1, min(streams, n // steps))
        length = -(-n // streams)
        # the last stream is filled from the beginning, so that no word is left out
        wrap = np.arange(streams * length) % n
        prev, goal = flat[:-1][wrap].reshape(streams, length), flat[1:][wrap].reshape(streams, length)
        h = np.zeros((streams, HIDDEN), np.float32)
        for t0 in range(0, length, steps):
            words = prev[:, t0 : t0 + steps].T
            n = len(words)
            x = gru.embed[words]
            states, gates = np.empty((n + 1, streams, HIDDEN), np.float32), []
            states[0] = h
            for t in range(n):
                states[t + 1], *gate = gru.step(x[t], states[t])
                gates.append(gate)
            h = states[n].copy()
            zr, c, gn = (np.stack(g) for g in zip(*gates))
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            grad = _zeros(gru)
            out = gru.log_probs(states[1:].reshape(-1, HIDDEN), goal[:, t0 : t0 + steps].T.reshape(-1), grad).reshape(n, streams, HIDDEN)
            # what a state's gradient is multiplied by, at every step, for the gates' gradients
            by = np.concatenate([(states[:-1] - c) * z * (1 - z), gn * r * (1 - r), (1 - z) * (1 - c * c)], 2)
            by[:, :, HIDDEN : 2 * HIDDEN] *= by[:, :, 2 * HIDDEN :]
            back, dx, dg = np.zeros_like(h), np.empty_like(by), np.empty_like(by)
            for t in range(n - 1, -1, -1):
                back = back + out[t]
                np.multiply(by[t].reshape(streams, 3, HIDDEN), back[:, None], out=dx[t].reshape(streams, 3, HIDDEN))
                dg[t] = dx[t]
                dg[t, :, 2 * HIDDEN :] *= r[t]
                back = back * z[t] + dg[t] @ gru.recur.T
            grad.recur += states[:-1].reshape(-1, HIDDEN).T @ dg.reshape(-1, 3 * HIDDEN)
            order = np.argsort(words, axis=None, kind="stable")
            sorted_ = words.reshape(-1)[order]
            first = np.nonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))[0]
            met = sorted_[first]
            grad.embed = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
            self._step(grad, met, 1 / (streams * n), rate(t0 / length))

    def _step(self, grad: Gru, met: np.ndarray, scale: float, rate: float) -> None:
        """``grad.embed`` has only the rows of the words ``met``; the others stay."""
        self.count += 1
        for k in NAMES:
            g = getattr(grad, k)
            g *= np.float32(scale)
            np.clip(g, -1, 1, out=g)
            at = met if k == "embed" else slice(None)  # a copy of the rows met, or the whole in place
            m, v, w = self.m[k][at], self.v[k][at], getattr(self.gru, k)
            m += np.float32(0.1) * (g - m)
            np.multiply(g, g, out=g)
            g -= v
            g *= np.float32(0.001)
            v += g
            size = np.float32(rate / (1 - 0.9**self.count))
            down = np.sqrt(v * np.float32(1 / (1 - 0.999**self.count)))
            down += np.float32(1e-8)
            np.divide(m, down, out=down)
            down *= size
            if k == "embed":
                self.m[k][at], self.v[k][at] = m, v
            w[at] -= down


def _zeros(gru: Gru) -> Gru:
    return Gru(np.zeros((0, 3 * HIDDEN), np.float32), *(np.zeros_like(getattr(gru, k)) for k in NAMES[1:]))


@dataclass
class LmModel:
    gru: Gru
    ids: dict[bytes, int]  # vocabulary; END is id 0, every other word OTHER
    head: dict[bytes, int]  # places of the commonest words, END among them, in the two arrays
    head_count: np.ndarray
    head_id: np.ndarray  # in the vocabulary
    tokens: int
    types: int
    outside: int  # sum of count + 1 over words outside the vocabulary, and one for the unseen

    OTHER = 1


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all of ``docs``, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return got

        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.update(tokens_of(t))
                if len(held) > 500_000:
                    yield out()
        yield out()

    return doc_text(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, use: Column, head: int = HEAD, sample: int = SAMPLE) -> tuple[LmModel, DataFrame]:
    """The model, and the table of counts, from the documents that ``use`` marks."""
    rows = docs.where(use)
    counts = checkpointed(count_tokens(rows))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # counts by eighths of their logarithm: under a thousand groups
    level = F.floor(F.log2("n") * 8).cast("int")
    by_level = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    held, least = 0, None
    for r in by_level:
        if held + r["count"] > head:
            break
        held, least = held + r["count"], r["level"]
    common = counts.where(level >= least).toArrow().to_pylist() if least is not None else []
    top = {r["word"]: r["n"] for r in common}
    size = vocabulary(total[1])
    words = [w for w in sorted(top, key=lambda w: (-top[w], w)) if w != END][: size - 2]
    ids = {END: 0} | {w: k + 2 for k, w in enumerate(words)}
    n_docs = counts.where(F.col("word") == F.lit(END)).first()
    inside = sum(top[w] + 1 for w in words) + (n_docs["n"] + 1 if n_docs else 0)
    places = {w: k for k, w in enumerate(top | {END: 0})}
    head_count = np.array([top.get(w, 0) for w in places], np.int64)
    model = LmModel(Gru.new(vocab=size), ids, places, head_count, coded(ids, list(places)), total[0], total[1], total[0] + total[1] - inside + 1)
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 32))
    below = int(4 * sample / max(1, n_docs["n"] if n_docs else 1) * (1 << 32)) + 1
    picked = rows.where(hashed < below).select("text", hashed.alias("h")).orderBy("h", "text").limit(sample).collect()
    model.gru.fit([coded(ids, tokens_of(r.text)) for r in picked], 0)
    model.gru = averaged(rows, model.gru, ids)
    return model, counts


def averaged(rows: DataFrame, gru: Gru, ids: dict[bytes, int], rate: float = 0.01) -> Gru:
    """``gru`` trained on by every partition over all its texts, then the mean of the partitions' weights by tokens."""
    shared = rows.sparkSession.sparkContext.broadcast((gru, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words = shared.value
        adam, held, size, n = Adam(start.filled(start.flat())), [], 0, 0

        def learn() -> None:
            adam.read(held, 0, max(1, min(STREAMS, size // 512)), 16, lambda done: rate)

        for batch in sliced(batches, ROWS):
            for text in batch.column("text").to_pylist():
                held.append(coded(words, tokens_of(text)))
                size += len(held[-1])
                if size >= PASS:
                    learn()
                    held, size, n = [], 0, n + size
        if held:
            learn()
            n += size
        if n:
            flat = adam.gru.flat()
            blocks = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "part": pa.array([part] * len(blocks), pa.int32()), "n": pa.array([n] * len(blocks), pa.int64()), "w": pa.array(blocks, pa.binary())})

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")  # else sums would depend on the order of arrival
        n = t.column("n").to_numpy().astype(np.float64)
        w = sum(np.frombuffer(b.as_py(), np.float32) * k for b, k in zip(t.column("w"), n)) / n.sum()
        return pa.table({"block": t.column("block").combine_chunks()[:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    got = doc_text(rows).select("text").mapInArrow(run, "block int, part int, n long, w binary").groupBy("block").applyInArrow(mean, "block int, w binary").collect()
    return gru.filled(np.frombuffer(b"".join(r.w for r in sorted(got, key=lambda r: r.block)), np.float32)) if got else gru


def coded(ids: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(ids.get, words, repeat(LmModel.OTHER)), np.int32, len(words))


def score(docs: DataFrame, model: LmModel, counts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, ``extra`` columns, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = m.head.get
        head_count, head_id = np.append(m.head_count, 0), np.append(m.head_id, LmModel.OTHER)  # the last: any other word
        for t in merged_batches(batches, BUFFER):
            seqs, n_tokens, n_known, logs, other_logs, n_other = [], [], [], [], [], []
            rest_words, rest_counts, rest_at = [], [], [0]
            for text in t.column("text").to_pylist():
                words = tokens_of(text)
                at = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                ids, found = head_id[at], head_count[at]
                known = found > 0
                lg = np.log10(found[known] + 1.0)
                seqs.append(ids)
                n_tokens.append(len(words))
                n_known.append(int(known.sum()))
                logs.append(float(lg.sum()))
                outside = ids == LmModel.OTHER
                n_other.append(int(outside.sum()))
                other_logs.append(float(lg[outside[known]].sum()))
                rest = Counter([words[k] for k in np.nonzero(~known)[0].tolist()])
                rest_words += rest
                rest_counts += rest.values()
                rest_at.append(len(rest_words))
            with np.errstate(over="ignore"):
                gru = m.gru.score(seqs, 0)
            # ends and vocabulary words are all in the head, so what is joined later is outside the vocabulary
            gru += np.array(other_logs) - np.array(n_other) * np.log10(float(m.outside))
            cols = {c: t.column(c).combine_chunks() for c in ["doc_id", "row", *extra]}
            cols |= {"n_tokens": pa.array(n_tokens, pa.int64()), "head_known": pa.array(n_known, pa.int64()), "logs": pa.array(logs), "gru": pa.array(gru), "rest": pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(rest_counts, pa.int64())], ["word", "n"]))}
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("doc_id", "row", *extra).schema)
    first = checkpointed(rows.mapInArrow(run, fields + ", n_tokens long, head_known long, logs double, gru double, rest array<struct<word:binary,n:long>>"))
    asked = first.select(F.col("row").alias("r"), F.inline("rest"))
    given = counts.select(F.col("word").alias("w"), F.col("n").alias("c"))
    met = asked.join(given, F.col("word") == F.col("w")).groupBy("r").agg(F.sum("n").alias("rest_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rest_logs"))
    out = first.join(met, F.col("row") == F.col("r"), "left")
    more = F.coalesce("rest_logs", F.lit(0.0))
    size = np.log10(float(model.tokens + model.types + 1))
    return out.select(
        "doc_id",
        *extra,
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(size))).alias("base_score"),
        (F.col("gru") + more).alias("score"),
    )
