import random
import re

import numpy as np
import xxhash

from tessella.llm import components, queries, simhash


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def brute(prints):
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2]
    return union(ids, near)


def test_query_equals_brute_force(spark, sf, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = brute(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


def test_links_of_planted_prints(spark, monkeypatch):
    rng = random.Random(5)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            prints.append(p)
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
    prints = dict(enumerate(dict.fromkeys(prints)))
    want = brute(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(signed(p),) for p in prints.values()], "fp long")
    number = {signed(p): i for i, p in prints.items()}
    for tile in (4096, 2):
        monkeypatch.setattr(simhash, "TILE", tile)
        found = {r.node: r.component for r in components.components(simhash.links(nodes)).collect()}
        groups = {}
        for f, i in number.items():
            groups.setdefault(found.get(f, f), []).append(i)
        assert {i: min(g) for g in groups.values() for i in g} == want


def test_large_tiles_compare_all():
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64) | np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    home = rng.random(len(fps)) < 0.5
    i, j = simhash.tile_links(np.zeros(len(fps), int), fps, home, 2)
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (home[a] or home[b]) and (int(fps[a]) ^ int(fps[b])).bit_count() <= 2]
    assert union(range(len(fps)), zip(i.tolist(), j.tolist())) == union(range(len(fps)), near)


def test_long_text_counts():
    text = " ".join(f"w{k % 7919}" for k in range(200_000))
    assert int(simhash.fingerprints_of(["a b", text, None])[1]) == fingerprint(text)


def test_odd_rows(spark, odd, nothing):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1)} <= got
    assert [g[2] for g in got if g[0] is None] == [None]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert rows == [-1, 1, 4, 5, 6]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_ids_of_any_size(spark):
    big = (1 << 62) + 5
    rows = [(big, "one two three four"), (big + 1, "one two three four"), (-(1 << 63), "five six seven"), ((1 << 63) - 1, "five six seven"), (7, "eight nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(big, big), (big + 1, big), (-(1 << 63), -(1 << 63)), ((1 << 63) - 1, -(1 << 63)), (7, 7)}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [-(1 << 63), 7, big]


def test_copies_without_ids_or_with_one_id_leave_one(spark):
    rows = [(None, "one two three four", "a"), (None, "one two three four", "b"), (3, "five six seven", "a"), (3, "five six seven", "a"), (3, "other words here", "a"), (None, "other words here", "a")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.text, r.doc_id) for r in got) == [("five six seven", 3), ("one two three four", None), ("other words here", 3)]


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in union(nodes, [e for e in edges if e[0] != e[1]]).items()}
