import glob
import math
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.operators import indexing as I
from tessella.operators import retrieval as R

HIT = "_rank int, source string, source_pdf_name string, page_start int, page_end int, section string, content_type string, content string"


def index(spark, rows):
    full = [(k, t, "", "", "", "s.md", f"{k}.pdf", 0, 0, "S", kind, I.hash_embedding([t])[0]) for k, t, kind in rows]
    return spark.createDataFrame(full, "chunk_id string, content string, section_title string, topic string, subtopic string, source string, source_pdf_name string, page_start int, page_end int, section string, content_type string, content_vector array<float>")


ROWS = [("a", "red apple. green apple pie", "text"), ("b", "blue sky", "table"), ("c", "apple", "table"), ("d", "nothing here", "text")]


def test_bm25(spark):
    got = R.bm25_topk(index(spark, ROWS), "apple PIE?", 10).orderBy("rank").collect()
    avg = (5 + 2 + 1 + 2) / 4

    def score(tfs, dl):
        return sum(math.log(1 + (4 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg)) for f, df in tfs)

    assert [(r.chunk_id, r["rank"]) for r in got] == [("a", 1), ("c", 2)]
    assert got[0].score == pytest.approx(score([(2, 2), (1, 1)], 5), abs=1e-6)
    assert R.bm25_topk(index(spark, ROWS), "?!", 10).count() == 0


def test_stored_postings_give_the_same(spark, tmp_path):
    ix, at = index(spark, ROWS + [("e", "", "text"), ("f", "Apple apple PIE", "text")]), str(tmp_path / "p")
    R.write_postings(ix, at, text=R.searchable())
    for q in ("apple PIE?", "nothing sky", "absent", "?!"):
        want = [tuple(r) for r in R.bm25_topk(ix, q, 3, text=R.searchable()).orderBy("rank").collect()]
        assert [tuple(r) for r in R.bm25_stored_topk(spark, at, q, 3).orderBy("rank").collect()] == want
    vector = I.hash_embedding(["apple"])[0]
    hits = lambda **o: R.hybrid_search(ix, "apple", vector, 3, **o).orderBy("_rank").collect()
    assert hits(postings=at) == hits() and hits(postings=at, content_type="table") == hits(content_type="table")
    plan = spark.read.parquet(f"{at}/terms").where("bucket = 3 and term = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,x)" in plan


def test_postings_are_dealt_out_once(spark, tmp_path, monkeypatch):
    odd = "İstanbul ΣΑΣ ΑΣ x_y ½ Ⅷ² 日本 naïve-e\u0301 \U0001d400 ٣٤ 'Straße' A1a a1A"
    rows = spark.createDataFrame([("a", odd), ("b", "red red Red"), ("c", ""), ("d", None)], "chunk_id string, content string")
    want = {r.chunk_id: Counter(r.t) for r in rows.select("chunk_id", R.tokens(F.coalesce("content", F.lit(""))).alias("t")).collect()}
    got = {r.key: (r.dl, Counter(dict(r.terms))) for r in R.term_counts(rows.selectExpr("chunk_id AS key", "lower(coalesce(content, '')) AS low")).collect()}
    assert got == {k: (c.total(), c) for k, c in want.items()}
    monkeypatch.setattr(R, "SEGMENT", 1)  # the buckets are split
    R.write_postings(rows, str(tmp_path / "p"))
    read = {}
    for f in glob.glob(f"{tmp_path}/p/terms/*/*.parquet"):
        t = pq.ParquetFile(f).read().to_pylist()
        assert [r["code"] for r in t] == sorted(r["code"] for r in t)
        for r in t:
            read.setdefault(r["key"], Counter())[r["term"]] += r["tf"]
    assert read == {k: c for k, c in want.items() if c}


def test_vectors_and_fusion(spark):
    ix = index(spark, ROWS)
    near = R.vector_topk(ix, I.hash_embedding(["apple"])[0], 2).orderBy("rank").collect()
    assert near[0].chunk_id == "c" and near[0].score == pytest.approx(1, abs=1e-6) and len(near) == 2
    hits = R.hybrid_search(ix, "apple", I.hash_embedding(["apple"])[0], 3).orderBy("_rank").collect()
    assert hits[0].chunk_id == "c" and all(0 < h._score <= 2 / 61 + 1e-6 for h in hits)
    assert [h._caption for h in hits if h.chunk_id == "a"] == ["red apple."]
    only = R.hybrid_search(ix, "apple", I.hash_embedding(["apple"])[0], 3, content_type="Table").collect()
    assert {h.chunk_id for h in only} == {"b", "c"}


def test_filters(spark):
    ix = index(spark, ROWS + [("O'Hara", "x", "text")])
    count = lambda **f: R.filtered(ix, **f).count()
    assert count(content_type="mixed") == count(content_type="all") == count(content_type="bogus") == count(source="ALL") == count() == 5
    assert count(content_type=" TABLE ") == 2 and count(source="O'Hara.pdf") == 1
    plan = R.filtered(ix, source="a.pdf")._jdf.queryExecution().optimizedPlan().toString()
    assert "a.pdf" in plan
    got = spark.createDataFrame([(" NULL ",), ("string",), ("  ",), (" a ",)], "v string").select(R.normalized(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == [None, None, None, "a"]


def test_rerank(spark):
    hits = spark.createDataFrame([(k + 1, f"h{k}") for k in range(3)], "_rank int, content string")
    names = lambda df: [r.content for r in df.collect()]
    assert names(R.rerank_by_reply(hits, "```json\n[0.2, 0.9, 0.9]\n```", 3, 2)) == ["h1", "h2"]
    for bad in ("[0.2, 0.9]", "no list", '["a", 1, 2]', '{"x": 1}'):
        assert names(R.rerank_by_reply(hits, bad, 3, 2)) == ["h0", "h1"]
    assert names(R.rerank(hits, None, 2)) == ["h0", "h1"]
    assert names(R.rerank(hits, R.coverage("h2"), 1)) == ["h2"]


def test_context(spark):
    hits = [(1, "x", "Con Ed.pdf", 2, 2, "A > B", "text", "x"), (2, "x", "NY ESCO Doc.pdf", 3, 5, "S", "table", "y"), (3, "x", "", None, 4, "Z", "figure", "z")]
    got = R.build_context(spark.createDataFrame(hits, HIT)).first().context
    assert got == "[SOURCE 1] [TABLE] S  (Pages 3–5)\ny\n\n---\n[SOURCE 2] [TEXT] A > B  (Page 2)\nx\n\n---\n[SOURCE 3] [FIGURE] Z\nz\n"
    assert R.build_context(spark.createDataFrame([], HIT)).first().context == ""


def test_prompts(spark):
    history = [("user", "u" * 300), ("assistant", "a"), ("user", "b"), ("assistant", "c"), ("user", "d")]
    df = spark.createDataFrame([(1, history), (2, [])], "k int, h array<struct<role:string,content:string>>")
    got = {r.k: r.t for r in df.select("k", R.recent_conversation(F.col("h")).alias("t")).collect()}
    assert got == {1: "ASSISTANT: a\nUSER: b\nASSISTANT: c\nUSER: d", 2: ""}
    m = {r.k: r.m for r in df.select("k", R.answer_messages("S", F.col("h"), F.lit("C"), F.lit("Q")).alias("m")).collect()}
    assert [x.role for x in m[2]] == ["system", "user"] and len(m[1]) == 7
    replies = ['{"standalone_query": "new"}', '"quoted"', "", '{"standalone_query": "cut', "{}"]
    got = spark.createDataFrame(list(enumerate(replies)), "k int, r string").orderBy("k").select(R.refined(F.col("r"), F.lit("old")).alias("q")).collect()
    assert [r.q for r in got] == ["new", "quoted", "old", '{"standalone_query": "cut', "{}"]


def test_context_keeps_hits_with_null_fields(spark):
    hits = [(1, "x", "a.pdf", 1, 1, "S", "text", "x", "T"), (2, "x", None, None, None, None, None, "y", "T"), (3, None, None, 2, None, None, "table", None, None)]
    got = R.build_context(spark.createDataFrame(hits, HIT + ", section_title string")).first().context
    assert got == "[SOURCE 1] [TEXT] S  (Page 1)\nx\n\n---\n[SOURCE 2] [TEXT] T\ny\n\n---\n[SOURCE 3] [TABLE]   (Pages 2–None)\n\n"


def test_query_terms_equal_column_tokens(spark):
    for q in ("Apple PIE_x, 3½ Ünï-cødé!", "", "漢字 a_b", "²①"):
        assert R.query_terms(q) == sorted(set(spark.range(1).select(R.tokens(F.lit(q)).alias("t")).first().t))


def test_chat(spark):
    seen = []

    def generate(messages):
        seen.append(messages)
        return f" {messages[-1]['content'].count('[SOURCE')} "

    ix = index(spark, ROWS)
    got = R.chat(ix, "green apple", I.hash_embedding, top_k=3, generate=generate, system="be exact")
    assert got.answer == "3" and got.hits.orderBy(F.desc("_rerank_score")).first().chunk_id == "a"
    assert [m["role"] for m in seen[0]] == ["system", "user"] and seen[0][0]["content"] == "be exact"
    assert seen[0][-1]["content"].endswith("=== QUESTION ===\ngreen apple")
    none = R.chat(ix, "x", I.hash_embedding, source="no.pdf")
    assert none.answer == R.NO_HITS and none.hits.count() == 0


def test_chat_with_history(spark):
    seen, asked = [], []
    history = [{"role": "user" if k % 2 == 0 else "assistant", "content": f"turn {k} " + "x" * 300} for k in range(9)]

    def refine(question, recent):
        asked.append((question, recent))
        return '{"standalone_query": "blue sky"}'

    got = R.chat(index(spark, ROWS), "and its colour?", I.hash_embedding, history, refine, generate=lambda m: seen.append(m) or "done", top_k=2)
    assert (got.refined_query, got.original_query, got.answer) == ("blue sky", "and its colour?", "done")
    [(question, recent)] = asked
    assert question == "and its colour?" and recent == "\n".join(f"{t['role'].upper()}: {t['content'][:200]}" for t in history[-4:])
    assert seen[0][1:-1] == history[-6:] and "b" in {r.chunk_id for r in got.hits.collect()}
    whole = R.chat(index(spark, ROWS), "and its colour?", I.hash_embedding, history, lambda q, r: "", top_k=2, reranking=False)
    assert whole.refined_query == "and its colour?" and "_rerank_score" not in whole.hits.columns


def test_default_profile_and_plain_hits(spark):
    got = R.chat_default(index(spark, ROWS), "apple", I.hash_embedding, content_type="table")
    hits = R.plain_hits(got.hits)
    assert {h["chunk_id"] for h in hits} == {"a", "b", "c", "d"} and [h["_rerank_score"] for h in hits] == sorted((h["_rerank_score"] for h in hits), reverse=True)
    assert R.plain({"a": (1, None, [b"x"]), "d": __import__("datetime").date(2020, 1, 2)}) == {"a": [1, None, ["b'x'"]], "d": "2020-01-02"}
