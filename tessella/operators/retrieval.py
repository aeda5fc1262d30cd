"""Filtered hybrid retrieval, reranking and context.

Filters come first, so that the best are the best of what passes. Lexical
statistics of a few query terms are one aggregate row; scores are then column
arithmetic over the scan and end in a top-k per partition: no shuffle of text.
"""

from __future__ import annotations

import contextlib
import datetime
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import normalize_filter, strip
from tessella.operators.indexing import INDEX_FIELDS
from tessella.sources.scratch import small_batches, written

K1, B = 1.2, 0.75
RRF_K = 60
TOP_K, TOP_N = 15, 15
#: weights of the searchable fields are equal: one text of all
SEARCH_FIELDS = ("section_title", "topic", "subtopic", "content")
#: index fields that a hit leaves out
UNSHOWN = {"heading_level", "region", "energy_utility_name", "has_table", "has_figure", "table_count", "figure_count"}
HIT_FIELDS = (*(f for f in INDEX_FIELDS if f not in UNSHOWN), "metadata_json")
# Filters, source order, prompt and answer are only right with exactly these.
CONTENT_TYPES = ("text", "table", "figure", "list")
PRIORITY_SOURCES = ("esco doc", "esco operating")
PROMPT = "Use the following source chunks to answer the question.\n\n=== SOURCE CHUNKS ===\n{context}\n\n=== QUESTION ===\n{question}"
NO_HITS = "I couldn't find relevant information for that question in the indexed documents. Try rephrasing, or check that the documents have been indexed."
HISTORY_TURNS, REWRITE_TURNS, REWRITE_CHARS = 6, 4, 200


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a literal: what ``tokens`` gives, without a job (runs of letters and digits of any script)."""
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def filters(content_type: str | None = None, source: str | None = None) -> list[Column]:
    """Equality predicates of the filters that say something; literals, so they reach the scan."""
    out = []
    kind, name = (None if v is None else v.strip() for v in (content_type, source))
    if kind and kind.lower() in CONTENT_TYPES:
        out.append(F.col("content_type") == kind.lower())
    if name and name.lower() not in ("all", "string", "unknown", "placeholder", "none", "null"):
        out.append(F.col("source_pdf_name") == name)
    return out


def filtered(index: DataFrame, content_type: str | None = None, source: str | None = None) -> DataFrame:
    for f in filters(content_type, source):
        index = index.where(f)
    return index


def bm25_topk(docs: DataFrame, query: str, k: int, key: str = "chunk_id", text: Column | str = "content") -> DataFrame:
    """key, score, rank of the ``k`` best by BM25; rows without any term are none."""
    terms = query_terms(query)
    if not terms:
        return docs.limit(0).select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    one = F.col(text) if isinstance(text, str) else text
    # a list of the query's own terms per row is all that leaves the scan; it is read twice, the text once
    held = docs.select(key, tokens(F.coalesce(one, F.lit(""))).alias("t"))
    held = held.select(key, F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(terms)).alias("m"))
    held = written(held)
    count = lambda term: F.size(F.filter("m", lambda x: x == term))
    tf = [count(t) for t in terms]
    stats = held.agg(  # one row of a few numbers
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(tf)]
    ).first()
    avgdl = stats["avgdl"] or 1.0
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(avgdl)))
    score = F.lit(0.0)
    for i, c in enumerate(tf):
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        score = score + F.lit(idf) * c * F.lit(K1 + 1) / (c + norm)
    best = held.where(F.size("m") > 0).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return ranked(best, key)


BUCKETS = 16
#: tokens whose postings one task sorts and writes as one file
SEGMENT = 4_000_000
#: rows whose terms are Python objects at once
ROWS = 100
#: runs of letters and digits of any script, as ``tokens`` has them
TERM = re.compile(r"[^\W_]+")


def _bucket(code: Column) -> Column:
    return F.pmod(code, F.lit(BUCKETS)).cast("int")


def term_counts(texts: DataFrame) -> DataFrame:
    """(key, low) to key, dl, terms: every row's number of tokens, and struct<term, tf> of its distinct ones; ``low`` is in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            size, ends, terms, tf = [], [0], [], []
            for t in b.column("low").to_pylist():
                found = Counter(TERM.findall(t))
                size.append(found.total())
                terms += found.keys()
                tf += found.values()
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int32())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["key", "dl", "terms"])

    small_batches(texts.sparkSession)
    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "low").mapInArrow(run, f"key {kind}, dl int, terms array<struct<term:string,tf:int>>")


def write_postings(docs: DataFrame, path: str, key: str = "chunk_id", text: Column | str = "content") -> None:
    """A stored text index: (code, term, key, tf, dl) by buckets of terms, sorted by the terms' hash codes, and one row of statistics.

    A later question reads the pages of its own terms alone, not the texts. Terms are
    counted within their row, so that postings are dealt out once and nothing else is.
    """
    one = F.col(text) if isinstance(text, str) else text
    held = written(term_counts(docs.select(F.col(key).alias("key"), F.lower(F.coalesce(one, F.lit(""))).alias("low"))))
    held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    stats = docs.sparkSession.read.parquet(f"{path}/stats").first()
    rows = held.select("key", "dl", F.inline("terms")).withColumn("code", F.xxhash64("term"))
    # frequent terms are many rows: buckets are split by key, into files of about one size
    split = int(stats.n * stats.avgdl) // (BUCKETS * SEGMENT) + 1
    part = _bucket(F.col("code")) * split + F.pmod(F.xxhash64("key"), F.lit(split)).cast("int")
    rows = rows.repartitionById(BUCKETS * split, part).sortWithinPartitions("code").withColumn("bucket", _bucket(F.col("code")))
    with one_writer_a_bucket(docs.sparkSession):
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


@contextlib.contextmanager
def one_writer_a_bucket(spark):
    """Rows are written in the order that they have, not sorted by bucket once more: a task has one bucket."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BUCKETS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bm25_stored_topk(spark, path: str, query: str, k: int, key: str = "chunk_id") -> DataFrame:
    """What ``bm25_topk`` gives, from the postings at ``path``."""
    terms = query_terms(query)
    rows = spark.read.parquet(f"{path}/terms")
    code = F.xxhash64(F.get(F.array(*map(F.lit, terms or [""])), F.col("id").cast("int")))
    named = spark.range(len(terms)).select(code.alias("c"), _bucket(code).alias("b")).collect()
    met = written(rows.where(F.col("bucket").isin([r.b for r in named]) & F.col("code").isin([r.c for r in named]) & F.col("term").isin(terms)))
    stats = spark.read.parquet(f"{path}/stats").first()
    df = {r.term: r.d for r in met.groupBy("term").agg(F.count(F.lit(1)).alias("d")).collect()}  # the question's terms
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(stats.avgdl) or 1.0))
    idf = F.lit(0.0)
    for t, d in df.items():
        idf = F.when(F.col("term") == t, F.lit(math.log(1 + (stats.n - d + 0.5) / (d + 0.5)))).otherwise(idf)
    scored = met.groupBy("key").agg(F.round(F.sum(idf * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)), 6).alias("score"))
    return ranked(scored.select(F.col("key").alias(key), "score").orderBy(F.desc("score"), key).limit(k), key)


def ranked(best: DataFrame, key: str) -> DataFrame:
    """``rank`` from 1 over an already limited result."""
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def cosine(v: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    size = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    v = v.cast("array<double>")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), zero, lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, zero, lambda a, x: a + x * x))
    return dot / F.nullif(norm * F.lit(size), F.lit(0.0))


def vector_topk(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", column: str = "content_vector") -> DataFrame:
    """key, score, rank of the ``k`` nearest by exact cosine."""
    scored = vectors.where(F.size(column) == len(query)).select(key, F.round(cosine(F.col(column), query), 6).alias("score"))
    return ranked(scored.where("score is not null").orderBy(F.desc("score"), key).limit(k), key)


def rrf(lexical: DataFrame, near: DataFrame, k: int, key: str = "chunk_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda name: F.coalesce(1.0 / (F.lit(constant) + F.col(name)), F.lit(0.0))
    both = lexical.select(key, F.col("rank").alias("r1")).join(near.select(key, F.col("rank").alias("r2")), key, "full_outer")
    best = both.select(key, F.round(part("r1") + part("r2"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return ranked(best, key)


def searchable() -> Column:
    return F.concat_ws(" ", *SEARCH_FIELDS)


def caption(content: Column, terms: list[str]) -> Column:
    """The sentence with most query terms, the first of several."""
    sentences = F.filter(F.transform(F.split(content, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")
    scored = F.transform(sentences, lambda s, i: F.struct((-F.size(F.array_intersect(tokens(s), F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")))).alias("n"), i.alias("i"), s.alias("s")))
    return F.array_min(scored)["s"]


def hybrid_search(index: DataFrame, query: str, vector: list[float], top_k: int = TOP_K, content_type: str | None = None, source: str | None = None, postings: str | None = None) -> DataFrame:
    """Hits: the index's hit fields with _score, _rank and _caption, ``top_k`` best of twice as many from each side.

    Without a filter the lexical side may come from stored ``postings`` of ``searchable()``; with one, statistics are those of what passes it, and the texts are read.
    """
    rows = filtered(index, content_type, source)
    stored = postings is not None and not filters(content_type, source)
    lexical = bm25_stored_topk(index.sparkSession, postings, query, 2 * top_k) if stored else bm25_topk(rows, query, 2 * top_k, text=searchable())
    best = rrf(lexical, vector_topk(rows, vector, 2 * top_k), top_k)
    best = best.select("chunk_id", F.col("score").alias("_score"), F.col("rank").alias("_rank"))
    hits = rows.select(*[c for c in HIT_FIELDS if c in index.columns]).join(F.broadcast(best), "chunk_id")  # top_k rows
    return hits.withColumn("_caption", caption(F.col("content"), query_terms(query)))


def coverage(query: str) -> Callable[[DataFrame], Column]:
    """Default scorer: the share of query terms that a hit's preview has."""

    def score(hits: DataFrame) -> Column:
        terms = query_terms(query)
        found = F.array_intersect(tokens(F.substring(F.coalesce("content", F.lit("")), 1, 400)), F.array(*map(F.lit, terms)))
        return F.size(found) / F.lit(len(terms)) if terms else F.lit(0.0)

    return score


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], Column] | None, top_n: int = TOP_N) -> DataFrame:
    """The ``top_n`` best, in the old order where scores are equal or there is no scorer."""
    if scorer is None:
        return hits.orderBy("_rank").limit(top_n)
    return hits.withColumn("_rerank_score", scorer(hits)).orderBy(F.desc("_rerank_score"), "_rank").limit(top_n)


def scores_reply(reply: str, n: int) -> Column:
    """A model's reply as an array of ``n`` scores; null unless it is exactly that."""
    bare = F.regexp_replace(F.regexp_replace(F.lit(reply), "```[a-z]*", ""), r"\A[\s`]+|[\s`]+\z", "")
    got = F.from_json(bare, "array<double>")
    return F.when(F.try_parse_json(bare).isNotNull() & (F.size(got) == n) & ~F.exists(got, lambda x: x.isNull()), got)


def rerank_by_reply(hits: DataFrame, reply: str, n: int, top_n: int = TOP_N) -> DataFrame:
    """Scores of a reply in the order of the hits; the old order where the reply is unusable."""
    score = F.get(scores_reply(reply, n), F.col("_rank") - 1)
    return hits.withColumn("_rerank_score", score).orderBy(F.desc_nulls_last("_rerank_score"), "_rank").limit(top_n)


def build_context(hits: DataFrame, order: list | None = None) -> DataFrame:
    """One row ``context``: numbered sources, those of priority first, otherwise in the order of the hits; a null field is empty, a null type text."""
    name = F.lower(F.coalesce(F.nullif("source_pdf_name", F.lit("")), "source", F.lit("")))
    later = F.lit(1)
    for p in PRIORITY_SOURCES:
        later = F.when(F.contains(name, F.lit(p)), 0).otherwise(later)
    n = F.row_number().over(W.orderBy(later, *(order or ["_rank"])))
    start, end = F.coalesce("page_start", F.lit(0)), F.col("page_end")
    page = F.when(start == 0, "").when(start == end, F.format_string("  (Page %d)", start)).otherwise(F.format_string("  (Pages %d–%s)", start, F.coalesce(end.cast("string"), F.lit("None"))))
    named = [F.col(c) for c in ("section", "section_title") if c in hits.columns]
    section = F.coalesce(*named, F.lit(""))
    kind = F.upper(F.coalesce("content_type", F.lit("text")))
    part = F.concat(F.lit("[SOURCE "), F.col("n").cast("string"), F.lit("] ["), kind, F.lit("] "), section, F.col("page"), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = hits.withColumn("page", page).withColumn("n", n).select("n", part.alias("part"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n---\n").alias("context"))


def last_turns(history: Column, n: int) -> Column:
    return F.slice(history, F.greatest(F.size(history) - F.lit(n - 1), F.lit(1)), n)


def recent_conversation(history: Column) -> Column:
    """The last four turns, 200 characters of each, for a query rewriter; empty without any."""
    said = F.transform(last_turns(history, REWRITE_TURNS), lambda t: F.concat(F.upper(t["role"]), F.lit(": "), F.substring(t["content"], 1, REWRITE_CHARS)))
    return F.array_join(said, "\n")


def refined(reply: Column, question: Column) -> Column:
    """The query of a rewriter's reply: a JSON field, the bare text, or the question itself."""
    raw = strip(reply)
    bare = F.regexp_replace(raw, "\\A[\"']+|[\"']+\\z", "")
    field = F.when(F.try_parse_json(raw).isNotNull(), F.get_json_object(raw, "$.standalone_query"))
    return F.coalesce(F.nullif(field, F.lit("")), F.nullif(bare, F.lit("")), question)


def answer_messages(system: str, history: Column, context: Column, question: Column) -> Column:
    """Roles and contents for a generator: system prompt, six last turns, context with the question."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    kept = F.transform(last_turns(history, HISTORY_TURNS), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    head, middle, tail = re.split(r"\{context\}|\{question\}", PROMPT)
    asked = F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))
    return F.concat(F.array(turn("system", F.lit(system))), kept, F.array(turn("user", asked)))


class Answer(NamedTuple):
    answer: str
    hits: DataFrame
    refined_query: str
    original_query: str


def chat(
    index: DataFrame,
    question: str,
    embedder: Callable[[list[str]], list[list[float]]],
    history: list[dict] | None = None,
    refine: Callable[[str, str], str] | None = None,
    scorer=None,
    generate: Callable[[list[dict]], str] | None = None,
    source: str | None = None,
    content_type: str | None = None,
    top_k: int = TOP_K,
    top_n: int = TOP_N,
    reranking: bool = True,
    system: str = "",
    no_hits: str = NO_HITS,
    postings: str | None = None,
) -> Answer:
    """Answers a question from the index.

    ``history``: the turns before, each with role and content. ``refine`` gets the
    question and the recent conversation and gives a rewriter's reply; the refined
    question searches, the question as asked reranks. ``generate`` gets the
    messages (system prompt, last turns, context with the question); without it
    the answer is the context. ``hits`` is a table that is computed once.
    """
    session, history = index.sparkSession, history or []
    asked = question
    if refine is not None:
        turns = session.createDataFrame([([(t["role"], t["content"]) for t in history],)], "h array<struct<role:string,content:string>>")
        reply = refine(question, turns.select(recent_conversation(F.col("h")).alias("t")).first().t)
        asked = session.range(1).select(refined(F.lit(reply), F.lit(question)).alias("q")).first().q
    hits = hybrid_search(index, asked, embedder([asked])[0], top_k, content_type, source, postings)
    best = written(rerank(hits, scorer or coverage(question), top_n)) if reranking else written(hits)
    order = [F.desc("_rerank_score"), "_rank"] if reranking else ["_rank"]
    context = build_context(best, order).first().context
    if not context:
        return Answer(no_hits, best, asked, question)
    if generate is None:
        return Answer(context, best, asked, question)
    messages = [{"role": "system", "content": system}, *({"role": t["role"], "content": t["content"]} for t in history[-HISTORY_TURNS:]), {"role": "user", "content": PROMPT.format(context=context, question=question)}]
    return Answer(generate(messages).strip(), best, asked, question)


def chat_default(index: DataFrame, question: str, embedder, history: list[dict] | None = None, generate=None, source: str | None = None, content_type: str | None = None, scorer=None, system: str = "") -> Answer:
    """The service's own settings: no refinement, reranking, fifteen hits; a content type is accepted and not used."""
    return chat(index, question, embedder, history, None, scorer, generate, source, None, 15, 15, True, system)


def plain(value):
    """A hit's value as JSON knows it: lists and maps inside, anything else as text."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value)


def plain_hits(hits: DataFrame) -> list[dict]:
    """At most ``TOP_N`` or so hits, as a caller outside Spark gets them, best first."""
    order = [F.desc("_rerank_score")] if "_rerank_score" in hits.columns else []
    return [plain(r.asDict(recursive=True)) for r in hits.orderBy(*order, "_rank").collect()]


def normalized(value: Column) -> Column:
    return normalize_filter(value)
