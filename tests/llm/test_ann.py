import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, queries


def brute(rows, k, asks):
    rows = sorted(rows)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for n, (i, q) in enumerate(zip(ids, x)):
        if asks(i):
            s = (q * x).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_recall_against_brute_force(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows, 5, lambda i: i % 50 == 0), found(queries.op3_ann(spark, sf))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = dict(rows)
    for q, near in got.items():
        for i, s in near:
            a, b = np.array(exact[q]), np.array(exact[i])
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], None), (2, [2.0, 0.0], None), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1)]
    df = frame(spark, rows).withColumn("vid", F.lit(1)).withColumn("code", F.lit("x"))
    got = found(ann.nearest(df, F.col("vec_id") % 10 == 0))
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 0.0)]}  # 10 has no other vector of its length
    assert ann.nearest(frame(spark, []), F.lit(True)).count() == 0


def test_ties_and_hot_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(300)] + [(1000 + i, rng.standard_normal(4).tolist(), 0) for i in range(50)]
    got = found(ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, probes=8))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[250]] == [0, 1, 2, 3, 4]


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [(r.vec_id, list(r.embedding), 0) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    whole = found(ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    for name, value in (("PAIRS", 40), ("SCORED", 640), ("ROWS_BYTES", 5000)):
        monkeypatch.setattr(ann, name, value)
    assert found(ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, block=4)) == whole


def test_few_pairs_are_scored_in_a_large_table():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50_000, 64))  # no structure: the hardest case
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, n = x[:200], ann.hashes_for(len(x), 64)
    assert n == 2 and ann.hashes_for(3_000_000, 64) == 3
    codes = np.stack([ann.probed_codes(q, t, n, ann.PROBES * ann.STEP ** (n - 1)) for t in range(ann.TABLES)], 1)
    best = ann.Best(ann.Block(np.arange(200), q, codes), 6)
    for a in range(0, len(x), 5000):
        best.add(np.arange(a, a + 5000), x[a : a + 5000], ann.bucket_codes(x[a : a + 5000], ann.TABLES, n))
    near = np.argsort(-(q @ x.T), 1)[:, :6]
    recall = np.mean([len(set(best.held[1][best.held[0] == k]) & set(near[k])) - 1 for k in range(200)]) / 5
    share = best.pairs / (200 * len(x))
    print(f"recall {recall:.3f}, share of pairs scored {share:.4f}")
    assert recall >= 0.9 and share < 0.1


def test_a_vector_is_in_its_nearest_bucket():
    rng = np.random.default_rng(5)
    for dim in (2, 3, 64, 300):
        x = rng.standard_normal((50, dim))
        first = np.stack([ann.probed_codes(x, t, 2, 5)[:, 0] for t in range(3)], 1)
        assert (first == ann.bucket_codes(x, 3, 2)).all()


def test_hadamard_is_orthogonal():
    h = ann.hadamard(np.eye(64))
    assert np.allclose(h @ h.T, np.eye(64))
