import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lm, queries
from tessella.llm.common import table


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_base_scores_equal_brute_force(spark, sf, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op9_lm(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        w, r = tokens(text), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0
    out = [r for i, r in got.items() if held[i]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # the network beats unigrams on unseen texts


def test_scores_equal_a_word_by_word_computation(spark, sf, texts):
    docs = table(spark, sf, "documents")  # dealt as in the query: every partition trains on its own texts
    model, _ = lm.train(docs.select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in lm.tokens_of(t))
    got = {r.doc_id: r.score for r in queries.op9_lm(spark, sf).collect()}
    g = model.gru
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, per = lm.HIDDEN, g.out_word.shape[2]
    some = [i for i, t in texts.items() if len(t or "") < 4000]
    assert len(some) > 100
    for i in some:
        h, prev, total = np.zeros(n), 0, 0.0
        for w in lm.tokens_of(texts[i]):
            x, r = g.embed[prev].astype(float), h @ g.recur
            z, reset = sig(x[:n] + r[:n]), sig(x[n : 2 * n] + r[n : 2 * n])
            cand = np.tanh(x[2 * n :] + reset * r[2 * n :])
            h = (1 - z) * cand + z * h
            k = model.ids.get(w, 1)
            a = np.append(h, 1) @ g.out_class
            b = np.append(h, 1) @ g.out_word[k // per]
            total += a[k // per] - np.log(np.exp(a).sum()) + b[k % per] - np.log(np.exp(b).sum())
            if k == 1:
                total += np.log((counts[w] + 1) / model.outside)
            prev = k
        assert got[i] == pytest.approx(total / np.log(10), rel=1e-3)


def test_tokens_beyond_the_head_are_joined(spark, docs):
    whole, counts = lm.train(docs, F.lit(True))
    few, counts2 = lm.train(docs, F.lit(True), head=3000)
    assert len(few.head) <= 3000 < len(whole.head)
    few.ids, few.gru, few.outside = whole.ids, whole.gru, whole.outside
    more = [w for w in whole.ids if w not in few.head]
    few.head |= {w: len(few.head) + k for k, w in enumerate(more)}
    few.head_count = np.append(few.head_count, [whole.head_count[whole.head[w]] for w in more])
    few.head_id = lm.coded(few.ids, list(few.head))
    a = {r.doc_id: r for r in lm.score(docs, whole, counts).collect()}
    for r in lm.score(docs, few, counts2).collect():
        assert (r.n_known, r.n_tokens) == (a[r.doc_id].n_known, a[r.doc_id].n_tokens)
        assert r.base_score == pytest.approx(a[r.doc_id].base_score, rel=1e-9)
        assert r.score == pytest.approx(a[r.doc_id].score, rel=1e-9)


def test_output_is_a_distribution():
    gru = lm.Gru.new()
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = gru.log_probs(np.repeat(h, lm.VOCAB, 0), np.arange(lm.VOCAB))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_over_windows():
    gru, rng = lm.Gru.new(), np.random.default_rng(2)
    docs = [rng.integers(0, lm.VOCAB, n) for n in (1, 3000, 33, 32, 500)]
    got = gru.score(docs, 0)
    for d, s in zip(docs, got):
        h, prev, total = np.zeros((1, lm.HIDDEN), np.float32), 0, 0.0
        for t in d:
            h = gru.step(gru.embed[[prev]], h)[0]
            total += float(gru.log_probs(h, np.array([t]))[0])
            prev = t
        assert s == pytest.approx(total / math.log(10), rel=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    docs = [rng.permutation(np.arange(2, 8)) for _ in range(4)] * 200
    gru = lm.Gru.new()
    before = gru.score(docs[:4], 0).sum()
    gru.fit(docs, 0, epochs=20)
    assert gru.score(docs[:4], 0).sum() > before / 2


def test_odd_rows(odd, nothing):
    model, counts = lm.train(odd, F.lit(True))
    got = lm.score(odd, model, counts).collect()
    assert len(got) == odd.count()
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    model, counts = lm.train(odd, F.lit(False))
    assert {(r.train_tokens, r.n_known) for r in lm.score(odd, model, counts).collect()} == {(0, 0)}
    assert lm.score(nothing, *lm.train(nothing, F.lit(True))).count() == 0


def test_network_learns_from_every_document(spark):
    text = "one two three four five six seven eight nine ten " * 40
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    model, _ = lm.train(docs, F.lit(True), sample=0)  # nothing but the pass over all documents
    ids = [lm.coded(model.ids, lm.tokens_of(text))]
    assert model.gru.score(ids, 0)[0] > 0.8 * lm.Gru.new().score(ids, 0)[0]


def test_vocabulary_grows_with_distinct_words():
    assert lm.vocabulary(0) == lm.VOCAB < lm.vocabulary(1_000_000) < lm.vocabulary(100_000_000)
    gru = lm.Gru.new(vocab=lm.vocabulary(4_000_000))
    n = len(gru.embed)
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    assert np.exp(gru.log_probs(np.repeat(h, n, 0), np.arange(n))).sum() == pytest.approx(1, abs=1e-4)


def test_no_word_is_left_out_of_a_pass():
    gru = lm.Gru.new()
    lm.Adam(gru).read([np.array([5, 6, 7])], 0, 4, 16, lambda done: 0.01)
    changed = (gru.embed != lm.Gru.new().embed).any(1)
    assert set(np.nonzero(changed)[0]) == {0, 5, 6}
