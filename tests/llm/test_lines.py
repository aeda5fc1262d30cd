import random
from collections import Counter

import pytest
import xxhash

from tessella.llm import lines, queries

SCHEMA = "doc_id long, text string, tag string"


def prose(rng, n):
    return [" ".join(f"{rng.getrandbits(40):x}" for _ in range(rng.randrange(4, 12))) for _ in range(n)]


def brute(rows, divisor=lines.DIVISOR, chunk_words=lines.CHUNK_WORDS, passage_words=lines.PASSAGE_WORDS):
    """Texts after dedup: every run is found by its definition and compared as text."""
    runs = {}
    docs = sorted((i, t) for i, t in rows)
    for d, (_, text) in enumerate(docs):
        part = [] if text is None else text.split("\n")
        words = [len(x.encode().split()) for x in part]
        found = set()
        hashes = [xxhash.xxh64_intdigest(x.encode()) for x in part]
        start = 0
        for k in range(len(part)):
            roll = hashes[k]
            for w in range(1, lines.WIDTH):
                if k >= w:
                    roll += hashes[k - w] * pow(lines._P, w, 1 << 64)
            roll %= 1 << 64
            roll ^= roll >> 29
            if roll % divisor == 0 or k == len(part) - 1:
                if k + 1 - start >= 2 and sum(words[start : k + 1]) >= chunk_words:
                    found.add((start, k + 1))
                start = k + 1
        for k in range(len(part)):
            e = next((e for e in range(k + 1, len(part) + 1) if sum(words[k:e]) > passage_words), None)
            s = next((s for s in range(k, -1, -1) if sum(words[s : k + 1]) > passage_words), None)
            found |= ({(k, e)} if e else set()) | ({(s, k + 1)} if s is not None else set())
        for s, e in found:
            runs.setdefault("\n".join(part[s:e]), []).append((d, s, e))
    gone = {}
    for places in runs.values():
        for d, s, e in sorted(places)[1:]:
            gone.setdefault(d, set()).update(range(s, e))
    return Counter((i, t if d not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])) for d, (i, t) in enumerate(docs))


def test_query_equals_brute_force(spark, sf, texts):
    got = queries.op5_line_dedup(spark, sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute(list(texts.items()))
    assert sum(r.n_removed for r in got) > 0
    assert all(r.n_lines == len((texts[r.doc_id] or "").split("\n")) for r in got)


def test_shared_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(8)
    passage = prose(rng, 12)
    assert sum(len(x.split()) for x in passage) > 50
    rows = []
    for i in range(40):
        own = prose(rng, 20)
        at = rng.randrange(21)
        rows.append((i, "\n".join(own if i % 2 else own[:at] + passage + own[at:]), None))
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _ in rows:
        if i % 2 or i == 0:
            assert got[i] == text
        else:
            assert got[i].split("\n") == [x for x in text.split("\n") if x not in passage]


def test_short_repeats_stay(spark):
    rows = [(i, f"unique {i}\ncommon short line\nanother one\nunique end {i}", None) for i in range(30)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: t for i, t, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    pool = prose(rng, 30)
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(40))) if i % 7 else None) for i in range(40)]
    got = lines.dedup(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute(rows)


def test_boundaries_resist_shifts():
    rng = random.Random(3)
    text = [x.encode() for x in prose(rng, 200)]
    runs = lambda t: {h for _, _, h in lines.candidates_of(t, passage_words=10**9)}
    before, after = runs(text), runs([b"a new first line", *text[:90], b"inserted", *text[90:]])
    assert len(before & after) >= len(before) - 4


def test_copies_and_odd_rows(spark, odd, nothing):
    rng = random.Random(9)
    text = "\n".join(prose(rng, 15))
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame([(3, text, None), (1, text, None), (2, text, None)], SCHEMA)).collect()}
    assert got == {1: text, 2: "", 3: ""}
    out = lines.dedup(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert lines.dedup(odd, counts=True).columns == [*odd.columns, "n_lines", "n_removed"]
    assert lines.dedup(nothing).count() == 0
