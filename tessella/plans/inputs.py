"""Inputs of the registered queries, derived from the driver tables, and the same in SQL.

Every function has a twin of the same name in ``SQL``: a SELECT that gives equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import spread

NOW = "2026-01-01T00:00:00+00:00"
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, utility, text: a Markdown document of every conversation, a heading and a page for each turn."""
    part = F.concat(F.lit('<!-- PageNumber="'), (F.col("turn") + 1).cast("string"), F.lit('" -->\n## '), "role", F.lit("\n\n"), "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"))
    one = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("body"))
    number = F.col("conv_id").cast("string")
    return one.select(F.concat(F.lit("conversation "), number, F.lit(".md")).alias("source"), F.lit("conversations").alias("utility"), F.concat(F.lit("# Conversation "), number, F.lit("\n"), "body").alias("text"))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r_regionkey, html: an HTML table of every region's nations."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    row = lambda x: F.concat(F.lit("<tr><td>"), x["n_nationkey"].cast("string"), F.lit("</td>\n<td><b>"), x["n_name"], F.lit("</b>|x</td></tr>"))
    head = F.concat(F.lit("before <table class='r'>\n<tr><th>key</th><th>"), "r_name", F.lit("</th><th></th></tr>"))
    joined = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("k"))
    return joined.select("r_regionkey", F.concat(head, F.array_join(F.transform("n", row), "\n"), F.lit("</table> after")).alias("html"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as layout results: a page for every 1000 characters, a paragraph for every 700, a table on every third page and the next."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    n = F.greatest(F.ceil(F.length("content") / 1000), F.lit(1)).cast("int")
    span = lambda at, size: F.struct(at.cast("int").alias("offset"), size.cast("int").alias("length"))
    left = lambda at, size: F.greatest(F.least(F.lit(size), F.length("content") - at), F.lit(0))
    # every fourth page has no words
    pages = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.when(i % 4 == 3, F.array().cast("array<struct<span:struct<offset:int,length:int>>>")).otherwise(F.array(F.struct(span(i * 1000, left(i * 1000, 990)).alias("span")))).alias("words"),
            F.array().cast("array<struct<spans:array<struct<offset:int,length:int>>>>").alias("lines"),
        ),
    )
    regions = lambda i: F.array(F.struct((i * 3 + 1).cast("int").alias("pageNumber")), F.struct((i * 3 + 2).cast("int").alias("pageNumber")))
    tables = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int")), lambda i: F.struct(regions(i).alias("boundingRegions")))
    count = F.greatest(F.ceil(F.length("content") / 700), F.lit(1)).cast("int")
    paragraphs = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.lit("p").alias("content"), F.array(span(i * 700, left(i * 700, 650))).alias("spans")))
    return docs.select("doc_id", "content", pages.alias("pages"), tables.alias("tables"), paragraphs.alias("paragraphs"))


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as session rows: the text asks, source answers; copies of a text repeat its question."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("s"), F.expr("doc_id div 40").cast("string")).alias("session_id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 30).cast("string")).alias("msg_id"),
        F.coalesce("text", F.lit("")).alias("question"),
        F.col("source").alias("answer"),
        F.lit(None).cast("string").alias("feedback"),
        F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 60), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw: a session JSON of every conversation, its user turns asking and the next turns answering."""
    from pyspark.sql import Window as W

    turns = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    q = F.to_json(F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("msgId"), F.col("text").alias("question"), after.alias("answer")), {"ignoreNullFields": "false"})
    rated = F.expr("regexp_replace(q, '[}]$', concat(',\"feedback\":', CASE turn % 3 WHEN 0 THEN 'null' WHEN 1 THEN '\"good, ok\"' ELSE '{\"r\":1,\"t\":\"a,b\"}' END, '}'))")
    asked = turns.withColumn("q", q).where("role = 'user'").select("conv_id", "turn", rated.alias("q"))
    one = asked.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "q"))), lambda x: x["q"]), ",").alias("m"))
    good = one.select(F.concat(F.lit('{"session_id":"c'), F.col("conv_id").cast("string"), F.lit('","messages":['), "m", F.lit("]}")).alias("raw"))
    return good.unionByName(one.select(F.concat(F.lit('{"session_id":'), F.col("conv_id").cast("string"), F.lit(",")).alias("raw")))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, mtime, size: documents as files of their source, some processed, with placeholders, nested and root files."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    i, s = F.col("doc_id").cast("string"), F.col("source")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(s, F.lit("/read-"), i, F.lit(".pdf"))).when(F.col("doc_id") % 17 == 0, F.concat(s, F.lit("/sub/"), i, F.lit(".pdf"))).when(F.col("doc_id") % 19 == 0, F.concat(i, F.lit(".pdf")))
    name = F.coalesce(name, F.concat(s, F.lit("/"), i, F.lit(".pdf")))
    both = d.where("doc_id % 6 = 0").select(F.concat(s, F.lit("/"), i, F.lit(".pdf")).alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"))
    keep = d.select(F.concat(s, F.lit("/.keep")).alias("path"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size")).distinct()
    return d.select(name.alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size")).unionByName(both).unionByName(keep)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, vector, seq: embeddings, every fifth once more with a later, rotated vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"))
    again = e.where("seq % 5 = 0").select("chunk_id", F.reverse("vector").alias("vector"), (F.col("seq") + 1_000_000).alias("seq"))
    return e.unionByName(again)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as index rows of one chunk each; the vector is null where there is no embedding."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    from tessella.functions import text as T

    return d.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat("source", F.lit(".md")).alias("source"),
        F.concat("source", F.when(F.col("doc_id") % 4 == 0, " ESCO Doc.pdf").otherwise(".pdf")).alias("source_pdf_name"),
        F.lit("").alias("source_pdf_url"),
        F.col("doc_id").cast("int").alias("chunk_index"),
        (F.col("doc_id") % 5).cast("int").alias("page_start"),
        (F.col("doc_id") % 5 + F.col("doc_id") % 2).cast("int").alias("page_end"),
        F.col("source").alias("topic"),
        F.col("lang").alias("subtopic"),
        F.col("lang").alias("section_title"),
        F.concat_ws(" > ", "source", "lang").alias("section"),
        text.alias("content"),
        T.content_type(text).alias("content_type"),
        F.col("embedding").alias("content_vector"),
    )


CONTENT_TYPE_SQL = f"""CASE WHEN strpos(c, '|') > 0 AND (strpos(c, '[Figure') > 0 OR strpos(c, '[Flowchart') > 0 OR strpos(c, '[Process Steps]') > 0) THEN 'mixed'
 WHEN strpos(c, '|') > 0 THEN 'table' WHEN strpos(c, '[Figure') > 0 OR strpos(c, '[Flowchart') > 0 OR strpos(c, '[Process Steps]') > 0 THEN 'figure'
 WHEN regexp_matches(c, '(?m)^{WS}*([0-9]+\\.|[-•*]){WS}') THEN 'list' ELSE 'text' END"""

SQL = {
    "markdown": """SELECT 'conversation ' || conv_id || '.md' AS source, 'conversations' AS utility, '# Conversation ' || conv_id || chr(10) ||
 string_agg('<!-- PageNumber="' || (turn + 1) || '" -->' || chr(10) || '## ' || role || chr(10) || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
    "session_rows": """SELECT 's' || doc_id // 40 AS session_id, 'm' || (doc_id % 30) AS msg_id, coalesce(text, '') AS question, source AS answer,
 CAST(NULL AS VARCHAR) AS feedback, strftime(make_timestamp((1700000000 + doc_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at FROM documents""",
    "paths": """SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/read-' || doc_id || '.pdf' WHEN doc_id % 17 = 0 THEN source || '/sub/' || doc_id || '.pdf' WHEN doc_id % 19 = 0 THEN doc_id || '.pdf'
 ELSE source || '/' || doc_id || '.pdf' END AS path, doc_id AS mtime, n_chars AS size FROM documents WHERE source IS NOT NULL
 UNION ALL SELECT source || '/' || doc_id || '.pdf', doc_id, n_chars FROM documents WHERE source IS NOT NULL AND doc_id % 6 = 0
 UNION ALL SELECT DISTINCT source || '/.keep', 0, 0 FROM documents WHERE source IS NOT NULL""",
    "vectors": """SELECT CAST(vec_id AS VARCHAR) AS chunk_id, embedding AS vector, vec_id AS seq FROM embeddings
 UNION ALL SELECT CAST(vec_id AS VARCHAR), list_reverse(embedding), vec_id + 1000000 FROM embeddings WHERE vec_id % 5 = 0""",
    "index": f"""SELECT *, {CONTENT_TYPE_SQL.replace("(c,", "(content,")} AS content_type FROM (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source || '.md' AS source, source || CASE WHEN doc_id % 4 = 0 THEN ' ESCO Doc.pdf' ELSE '.pdf' END AS source_pdf_name,
 CAST(doc_id AS INTEGER) AS chunk_index, CAST(doc_id % 5 AS INTEGER) AS page_start, CAST(doc_id % 5 + doc_id % 2 AS INTEGER) AS page_end, source AS topic, lang AS subtopic, lang AS section_title,
 concat_ws(' > ', source, lang) AS section, coalesce(text, '') AS content, embedding AS content_vector FROM documents LEFT JOIN embeddings ON doc_id = vec_id)""",
    "layout": """SELECT doc_id, coalesce(text, '') AS content, greatest(CAST(ceil(length(coalesce(text, '')) / 1000) AS INTEGER), 1) AS n, greatest(CAST(ceil(length(coalesce(text, '')) / 700) AS INTEGER), 1) AS np FROM documents""",
    "html_tables": """SELECT r_regionkey, 'before <table class=''r''>' || chr(10) || '<tr><th>key</th><th>' || r_name || '</th><th></th></tr>' ||
 string_agg('<tr><td>' || n_nationkey || '</td>' || chr(10) || '<td><b>' || n_name || '</b>|x</td></tr>', chr(10) ORDER BY n_nationkey) || '</table> after' AS html FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""",
}
