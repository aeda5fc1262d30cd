"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are runs of 2 to 4 UTF-8 bytes of the lower-cased text, in which all
ASCII but letters is blank. Each is hashed to a row of an embedding table; a
text is the average of its rows, and a softmax over it gives the language. Both
are trained by stochastic gradient descent in numpy, on a sample: of each
language the same number of distinct labelled texts, at most ``PER_LANG`` and
together at most ``SAMPLE``, each an excerpt of at most ``EXCERPT`` characters
from a place that its hash chooses. Every language is learned, however many
there are (up to ``SAMPLE``) and however few texts one has. A fifth of the
sample calibrates: a temperature, and the confidence under which a text is
rejected, so that at most ``reject_share`` of known texts are.

Defined cases: a text that is null or has no letter (Unicode category L) is
``und``, score 0, and rejected; with no labelled rows every text is ``und``;
rows with a null lang are predicted but not learned from; repeated rows are
learned from once and each predicted; of equally likely languages the first in
order of code points is taken; texts of any length are predicted whole, some
250,000 characters at a time or one text; an empty table gives no rows; columns
named lang_pred, score or rejected are replaced, others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, map_arrow, shielded, without

UND = "und"
BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
PER_LANG = 600
SAMPLE = 60_000
EXCERPT = 2000
STEP_CHARS = 250_000
PAD = b" " * max(ORDERS)
_LETTER = regex.compile(r"\p{L}").search
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all subwords (orders by positions, flat for each order) and the first position of each text; none reaches into the next text."""
    parts = [t.lower().encode("utf-8", "replace").translate(_TABLE) + PAD for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    b = np.frombuffer(b"".join(parts) + PAD, np.uint8).astype(np.uint32)
    n = first[-1]
    out, code = np.empty((len(ORDERS), n), np.int32), b[:n].copy()
    for order in range(2, max(ORDERS) + 1):
        code = code * np.uint32(256) + b[order - 1 : n + order - 1]
        if order in ORDERS:
            mixed = (code + np.uint32(order * 0x51ED27)) * np.uint32(2654435761)
            out[ORDERS.index(order)] = (mixed ^ mixed >> np.uint32(15)) >> np.uint32(17)
    beyond = len(PAD) - 1  # last places of a text's padding: what begins there would end in the next text
    inner = np.ones(n, bool)
    inner[(first[1:, None] - 1 - np.arange(beyond)).reshape(-1)] = False
    return out[:, inner], first - beyond * np.arange(len(first))


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS rows: embeddings, already times ``weight`` where that makes them shorter
    weight: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, first = subwords(texts)
        total = sum(np.add.reduceat(self.table[r], first[:-1], axis=0) for r in rows)
        mean = total / (len(rows) * np.diff(first))[:, None]
        z = ((mean if self.weight is None else mean @ self.weight) + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability, and whether it is rejected."""
        lang, score = [UND] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if t and self.langs and _LETTER(t)]
        at, size = 0, 0
        for stop, k in enumerate(known, 1):
            size += len(texts[k])
            if size > STEP_CHARS or stop == len(known):
                some = known[at:stop]
                p = self.scores([texts[j] for j in some])
                for j, best, q in zip(some, p.argmax(1), p.max(1)):
                    lang[j], score[j] = self.langs[best], q
                at, size = stop, 0
        return lang, score, np.array([x == UND for x in lang], bool) | (score < self.threshold)


def fit(samples: list[tuple[str, str]], epochs: int = 4, rate: float = 1.0, reject_share: float = 0.001, seed: int = 7) -> LangModel:
    """``samples``: (text, lang). The order of the rows does not matter."""
    samples = sorted((t, y) for t, y in samples if t and y is not None and _LETTER(t))
    langs = sorted({y for _, y in samples})
    if not samples:
        return LangModel([], np.zeros((BUCKETS, 0), np.float32), None, np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = set(order[: len(samples) // 5].tolist())
    table = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    weight, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    rows = []
    cuts = []  # some words out of each text, so that short texts are learned and calibrated too
    for t, y in samples:
        w = t.split()
        n = int(rng.integers(1, 9))
        at = int(rng.integers(0, max(1, len(w) - n)))
        cuts.append((" ".join(w[at : at + n]), y))
    for t, y in samples + cuts:
        r, _ = subwords([t])
        ids, n = np.unique(r, return_counts=True)
        rows.append((ids, (n / r.size).astype(np.float32), langs.index(y)))
    held |= {k + len(samples) for k in held}
    train = [k for k in range(len(rows)) if k not in held] or list(range(len(rows)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(train):
            ids, share, y = rows[k]
            hidden = share @ table[ids]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weight @ p
            weight -= 0.2 * step * np.outer(hidden, p)
            bias -= 0.005 * step * p
            table[ids] -= step * share[:, None] * back
    logits = np.array([rows[k][1] @ (table[rows[k][0]] @ weight) + bias for k in (sorted(held) or train)])
    truth = np.array([rows[k][2] for k in (sorted(held) or train)])

    def loss(t: float) -> float:
        z = logits / t
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), truth]).mean())

    temperature = min(np.geomspace(0.2, 10, 81), key=loss)
    z = logits / temperature
    best = (1 / np.exp(z - z.max(1, keepdims=True)).sum(1))[: max(1, len(z) // 2)]  # whole texts
    threshold = min(float(np.quantile(best, reject_share, method="lower")) * 0.9, 0.5)
    few = len(langs) <= DIM
    return LangModel(langs, (table @ weight).astype(np.float32) if few else table, None if few else weight, bias, float(temperature), threshold)


def sample(docs: DataFrame, use: Column, per_lang: int = PER_LANG, most: int = SAMPLE) -> list[tuple[str, str]]:
    """Excerpts (text, lang) of distinct texts of the rows that ``use`` marks: for each language those least by a hash of text."""
    rows = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("x", F.xxhash64("text"))
    # a sketch of each language's distinct texts; copies have one hash, so that no number of them crowds out others
    texts = checkpointed(rows.groupBy("lang").agg(F.approx_count_distinct("x").alias("texts")))
    n = texts.count()
    each = max(1, min(per_lang, most // max(1, n)))
    # about eight times what is wanted goes on, so that a frequent language is no large group
    below = texts.select(F.col("lang").alias("l"), (8 * each / F.col("texts") * (1 << 32)).alias("below"))
    hash_ = F.pmod("x", F.lit(1 << 32))
    at = F.pmod(F.xxhash64("x"), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    rows = rows.join(F.broadcast(below) if n <= most else below, F.col("lang") == F.col("l")).where(hash_ < F.col("below")).select("lang", hash_.alias("hash"), "x", F.substr("text", at, F.lit(EXCERPT)).alias("text"))
    rows = rows.dropDuplicates(["lang", "x"])
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash", "text"))
    return [(r.text, r.lang) for r in rows.withColumn("k", rank).where(F.col("k") <= each).select("text", "lang").collect()]


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """``docs`` with lang_pred, score, rejected."""
    docs = without(docs, ("lang_pred", "score", "rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(docs.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(lang), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, fields + ", lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: LangModel) -> DataFrame:
    """``docs``, all columns as they are, without the rows that the model rejects."""
    hidden, back = shielded(docs, ("text",))
    return back(identify(hidden, model).where("not rejected"))
