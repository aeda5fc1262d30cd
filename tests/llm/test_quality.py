import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, queries


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and label.get(r.doc_id) is not None]
    y, s = np.array([label[r.doc_id] for r in held]), np.array([r.score for r in held])
    assert auc(s, y) > 0.9
    assert np.mean((s - y) ** 2) < np.mean((y.mean() - y) ** 2)  # better than the base rate


def naive_units(text):
    """Buckets of a text's units, one run of bytes after the other."""
    data, out, i, before = (text or "").encode(), [], 0, None
    kind = lambda c: 0 if c <= 32 else 1 if chr(c).isalpha() and c < 128 or c >= 128 else 2 if 48 <= c <= 57 else c + 128
    mask, odd, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def bucket(code):
        code = code * mix & mask
        return ((code ^ code >> 32) * mix & mask) >> 51

    while i < len(data):
        k, j = kind(data[i]), i
        while j < len(data) and kind(data[j]) == k:
            j += 1
        run, n = data[i:j], j - i
        i = j
        if k == 0:
            continue
        code = sum((c + 33 if 65 <= c <= 90 else c + 1) * pow(odd, p, 1 << 64) for p, c in enumerate(run)) & mask
        code = 7 + min(n, 32) if k == 2 else k * 16 + min(n, 8) + 1000 if k > 2 else code
        out.append(bucket(code))
        if k == 1:
            upper = [65 <= c <= 90 for c in run]
            case = 0 if not any(upper) else 1 if all(upper) else 2 if sum(upper) == 1 and upper[0] else 3
            out.append(bucket(1 << 41 if before == (1, code) else (1 << 40) + case * 64 + min(n, 24)))
        before = (k, code)
    return out


def test_query_equals_brute_force(spark, sf, texts):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, ~quality_held())
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    place, sign = quality.index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts.values():
        u = naive_units(t)
        for i in range(len(u)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(u):
                    np.add.at(sums[u[i]], place[u[j]], sign[u[j]])
    index = np.zeros_like(sums)
    for b in range(quality.BUCKETS):
        np.add.at(index[b], place[b], sign[b])
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    vectors = unit(sums) + unit(index)
    for i, t in texts.items():
        u = naive_units(t)
        x = vectors[u].mean(0) if u else np.zeros(quality.DIM)
        z = np.tanh((x - model.mean) / model.scale @ model.w1 + model.b1) @ model.w2 + model.b2
        p = 1 / (1 + np.exp(-z / model.temperature))
        assert got[i].score == pytest.approx(p, abs=1e-5)
        assert got[i].predicted == int(got[i].score >= 0.3)


def quality_held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def test_context_sums_equal_a_count():
    texts = ["a b c a", None, "B b"]
    place, sign = quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.DIM))
    quality.context_sums(texts, total, place, sign)
    want = np.zeros_like(total)
    for t in texts:
        u, _ = quality.units([t])
        for i in range(len(u)):
            for j in range(len(u)):
                if i != j and abs(i - j) <= 2:
                    for k in range(quality.MARKS):
                        want[u[i], place[u[j], k]] += sign[u[j], k]
    assert np.allclose(total, want)


def test_corpus_vectors_do_not_depend_on_partitions(docs):
    assert (quality.corpus_vectors(docs.repartition(5)) == quality.corpus_vectors(docs.coalesce(1))).all()


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (4, 0, 1, "x"), (5, None, 0, "x"), (None, 1, 0, "x"), (4, 1, 0, "y")], "doc_id long, quality int, toxic int, text string")
    model = quality.train(odd, labels, F.lit(True))
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {1.0}
    model = quality.train(odd, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(nothing, quality.train(nothing, labels, F.lit(True))).count() == 0
    assert quality.train(nothing, labels, F.lit(True)).constant == pytest.approx(0.5)
