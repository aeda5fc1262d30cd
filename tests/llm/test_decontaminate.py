import hashlib
import random
import re

import pytest

from tessella.llm import decontaminate as D
from tessella.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(items, size=13):
    out = {}
    for row, (i, text) in enumerate(items):
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[k : k + size]), []).append((row, str(i)))
    return out


def brute(text, found):
    w = words(text)
    hit, ids = set(), set()
    for size in {len(x) for x in found}:
        for k in range(len(w) - size + 1):
            if who := found.get(tuple(w[k : k + size])):
                hit |= set(range(k, k + size))
                ids |= set(who)
    sha = hashlib.sha256(",".join(sorted(i for _, i in ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_query_equals_brute_force(spark, sf, texts):
    found = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    got = rows(queries.op7_decontaminate(spark, sf))
    assert got == sorted((i, *brute(t, found)) for i, t in texts.items())
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("shard", [10**6, 60, 7])
def test_random_overlaps(spark, shard):
    rng = random.Random(shard)
    vocabulary = ["a", "b", "c", "É", "9x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 5, 9, 20])))) for i in range(25)] + [(99, None), (100, "a b c a b c"), (101, "b, B!")] * 2 + [(102, "b b"), (103, " ".join(["a", "b", "c"] * 40))]
    docs = [(i, "-".join(rng.choice(vocabulary + ["zz"]) for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, "")]
    found = windows(items, 5)
    got = rows(D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, shard))
    assert got == sorted((i, *brute(t, found)) for i, t in docs)


@pytest.mark.parametrize("shard", [10**6, 4])
def test_repeated_items_and_any_columns(spark, shard):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "One two, three"), (3, "four five"), (None, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three y", {"a": 1}, 5, "z"), (1, "x one two three y", {"b": 1}, 6, "z"), (2, None, None, None, None), (3, "four five", {}, 7, "z")], "doc_id long, text string, m map<string,int>, N_words int, spans string")
    got = D.scan(docs, bench, 13, shard)
    assert got.columns == ["doc_id", "text", "m", "n_words", "spans", "items"]
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.spans], r["items"]) for r in got.collect()) == [(1, 5, [(1, 4)], ["1", "1", "2"])] * 2 + [(2, 0, [], []), (3, 2, [(0, 2)], ["", "3"])]
    kept = D.clean(docs, bench, 13, shard_words=shard)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert sorted(r.n_items for r in D.report(docs, bench, 13, shard).collect()) == [0, 2, 3, 3]


def test_clean_cuts_spans_and_drops_the_worst(spark, sf, texts, odd, nothing):
    item = " ".join(f"item{k}" for k in range(20))
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, own(1, 600)), (2, own(2, 400) + ", " + item.upper() + "! " + own(2, 400)), (3, own(3, 30) + " " + item), (4, None)]
    got = {r.doc_id: r.text for r in D.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: docs[0][1], 2: own(2, 400) + ", ! " + own(2, 400), 4: None}
    two = bench.unionAll(spark.createDataFrame([(2, "some other item of words")], bench.schema))
    sharded = D.clean(spark.createDataFrame(docs, "doc_id long, text string"), two, shard_words=20)
    assert {r.doc_id: r.text for r in sharded.collect()} == got
    out = D.clean(odd, bench)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert D.clean(nothing, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.clean(odd, empty).count() == odd.count()
    assert all(r[2] == 0 for r in rows(D.report(odd, empty)))
