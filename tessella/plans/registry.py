"""Registered queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking as C
from tessella.operators import indexing as I
from tessella.operators import layout as L
from tessella.operators import retrieval as R
from tessella.operators import sessions as S
from tessella.plans import inputs
from tessella.plans.inputs import CONTENT_TYPE_SQL, NOW, SQL, WS, sql_strip, table
from tessella.sources import files
from tessella.sources.scratch import shared_folder, spread, written
from tessella.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "retrieval_context"
QUESTION = "Which general public license version applies to the work?"


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Text and chunk columns


@query("SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS token_estimate FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("token_estimate"))


@query(f"SELECT doc_id, {CONTENT_TYPE_SQL} AS content_type FROM (SELECT doc_id, text AS c FROM documents)")
def content_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_type(F.col("text")).alias("content_type"))


MARKED = "concat(CASE WHEN doc_id % 3 = 0 THEN concat('[Figure Caption] c', chr(10)) WHEN doc_id % 3 = 1 THEN concat('OWNER NAME: x', chr(10)) ELSE '' END, coalesce(text, ''))"


@query(
    f"""SELECT doc_id, strpos(c, '|') > 0 OR regexp_matches(c, '(?m)^[A-Z ]{{4,}}:{WS}') AS has_table,
 strpos(c, '[Figure Caption]') > 0 OR strpos(c, '[Figure Description]') > 0 OR strpos(c, '[Figure Content]') > 0 AS has_figure FROM (SELECT doc_id, {MARKED} AS c FROM documents)"""
)
def content_flags(spark, sf_dir):
    c = F.expr(MARKED)
    return table(spark, sf_dir, "documents").select("doc_id", T.has_table(c).alias("has_table"), T.has_figure(c).alias("has_figure"))


ID_SQL = """concat_ws('_', regexp_replace(regexp_replace({stem}, '[^A-Za-z0-9_\\-=]+', '_', 'g'), '^_+|_+$', '', 'g'), lpad(CAST({i} AS VARCHAR), CAST(greatest(4, length(CAST({i} AS VARCHAR))) AS INTEGER), '0'),
 substr(md5({src} || ':' || {i} || ':' || substr({c}, 1, 80)), 1, 12))"""


@query(f"SELECT doc_id, {ID_SQL.format(stem="source || ' (v1)'", i='doc_id', src="source || ' (v1).md'", c="coalesce(text, '')")} AS chunk_id FROM documents")
def chunk_id(spark, sf_dir):
    name = F.concat("source", F.lit(" (v1).md"))
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(name, F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("chunk_id"))


HEAD = """concat(CASE WHEN doc_id % 2 = 0 THEN concat('Source PDF: [', source, '.pdf](https://x.org/', doc_id, ')') ELSE concat('Source PDF at https://x.org/d/', doc_id, '.pdf?v=1') END, chr(10), 'Total Pages: ', doc_id % 90, chr(10),
 'total tables = ', doc_id % 7, chr(10), 'Version ', doc_id % 9, '.1', chr(10), 'Case 98-M-', doc_id, chr(10), 'Submitted: May ', doc_id % 30, chr(10), coalesce(text, ''))"""


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(h, '(?i)Source PDF[^\\[\\n]*\\[') THEN regexp_extract(h, '(?i)Source PDF[^\\[\\n]*\\[([^\\]]+)\\]\\(([^)\\n]+)\\)', 1) ELSE doc_id || '.pdf' END AS source_pdf_name,
 CASE WHEN regexp_matches(h, '(?i)Source PDF[^\\[\\n]*\\[') THEN regexp_extract(h, '(?i)Source PDF[^\\[\\n]*\\[([^\\]]+)\\]\\(([^)\\n]+)\\)', 2) ELSE regexp_extract(h, '(?i)Source PDF[^h\\n]*(https?://[^\\s)\\n]+)', 1) END AS source_pdf_url,
 CAST(regexp_extract(h, '(?i)Total Pages[^0-9\\n]*([0-9]+)', 1) AS INTEGER) AS total_pages, CAST(regexp_extract(h, '(?i)Total Tables[^0-9\\n]*([0-9]+)', 1) AS INTEGER) AS total_tables,
 regexp_extract(b, '(?i)VERSION\\s+([0-9.]+)', 1) AS doc_version, regexp_extract(b, '(?i)Case\\s+([0-9-]+[A-Z]-[0-9]+)', 1) AS case_number, trim(regexp_extract(t, '(?i)Submitted:\\s*([^\\n"*]+)', 1)) AS submitted
 FROM (SELECT doc_id, substr(t, 1, 3000) AS h, substr(t, 1, 8000) AS b, t FROM (SELECT doc_id, {HEAD} AS t FROM documents))"""
)
def doc_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(HEAD).alias("t"))
    return docs.select("doc_id", *[c.alias(k) for k, c in T.doc_metadata(F.col("t")).items()])


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_\\-]', '_', 'g'), '^_+|_+$', '', 'g') AS safe_name FROM pages")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe_name"))


# Splitting, parsing, packing


def _rfind(sep: str) -> str:
    """0-based place of the last ``sep`` in the window w, -1 without one."""
    n = f"length({sep})"
    return f"CASE WHEN strpos(reverse(w), reverse({sep})) = 0 THEN -1 ELSE length(w) - strpos(reverse(w), reverse({sep})) - {n} + 1 END"


def split_sql(source: str, key: str) -> str:
    """Recursive CTE pieces(key, step, piece) of ``source`` (key, t)."""
    stop = f"""CASE WHEN pos + 2400 >= length(t) THEN pos + 2400 WHEN {_rfind("chr(10) || chr(10)")} > 320 THEN pos + {_rfind("chr(10) || chr(10)")} + 2
 WHEN {_rfind("'. '")} > 320 THEN pos + {_rfind("'. '")} + 2 WHEN {_rfind("chr(10)")} > 320 THEN pos + {_rfind("chr(10)")} + 1 ELSE pos + 2400 END"""
    return f"""src AS MATERIALIZED ({source}), walk AS (SELECT {key}, t, 0 AS step, CAST(0 AS BIGINT) AS pos, CASE WHEN length(t) <= 2400 THEN CAST(2400 AS BIGINT) ELSE stop0 END AS stop
 FROM (SELECT {key}, t, {stop} AS stop0 FROM (SELECT {key}, t, CAST(0 AS BIGINT) AS pos, substr(t, 1, 2400) AS w FROM src))
 UNION ALL SELECT {key}, t, step, pos, {stop} AS stop FROM (SELECT {key}, t, step + 1 AS step, stop - 320 AS pos, substr(t, stop - 320 + 1, 2400) AS w FROM walk WHERE length(t) > 2400 AND stop - 320 < length(t))),
 pieces AS (SELECT {key}, step, CASE WHEN length(t) <= 2400 THEN t ELSE {sql_strip("substr(t, pos + 1, stop - pos)")} END AS piece FROM walk WHERE {sql_strip("substr(t, pos + 1, stop - pos)")} <> '')"""


SPLIT_SQL = split_sql("SELECT doc_id, coalesce(text, '') AS t FROM documents", "doc_id")


@query(f"WITH RECURSIVE {SPLIT_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS piece_no, piece AS content FROM pieces")
def split_overlap(spark, sf_dir):
    return C.split_documents(spread(table(spark, sf_dir, "documents")), ["doc_id"])


LINES_SQL = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
TURN_BLOCKS = f"""turns AS (SELECT conv_id, turn, role, text, CAST(turn + 1 AS INTEGER) AS p, CAST(coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn) + 1 AS INTEGER) AS q FROM conversations),
 each AS (SELECT conv_id, turn, role, p, q, unnest({LINES_SQL}) AS line, generate_subscripts({LINES_SQL}, 1) AS n FROM turns),
 blocks AS (SELECT conv_id, turn, role, p, q, {sql_strip("line")} AS block, n FROM each WHERE {sql_strip("line")} <> '')"""


@query(
    f"""WITH {TURN_BLOCKS} SELECT 'conversation ' || conv_id || '.md' AS source, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS section_no,
 CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS INTEGER) AS block_no, 'Conversation ' || conv_id || ' > ' || role AS headings, p AS page_start, q AS page_end, 'text' AS kind, block AS text FROM blocks"""
)
def markdown_blocks(spark, sf_dir):
    return C.markdown_blocks(inputs.markdown(spark, sf_dir), ["source"]).withColumn("headings", F.array_join("headings", " > "))


@query(
    """SELECT conv_id, string_agg(role || ' ' || turn, ' > ' ORDER BY turn) AS section, CAST(count(*) AS INTEGER) AS depth, any_value(role || ' ' || turn ORDER BY turn DESC) AS title
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE n > (total - 1) // 4 * 4 GROUP BY conv_id"""
)
def heading_breadcrumb(spark, sf_dir):
    """A level deeper at each turn, back to the first after four: the stack holds the turns since then."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    heads = F.transform("t", lambda x, i: F.struct((i % 4 + 1).alias("lvl"), F.concat_ws(" ", x["role"], x["turn"].cast("string")).alias("txt")))
    found = C.breadcrumb(C.heading_stack(heads))
    return turns.select("conv_id", found["section"].alias("section"), found["heading_level"].alias("depth"), found["section_title"].alias("title"))


PARAGRAPHS = f"""paragraphs AS (SELECT conv_id, turn, role, p, q, string_agg(block, chr(10) || chr(10) ORDER BY n) AS t FROM blocks GROUP BY conv_id, turn, role, p, q)"""
CHUNKS_SQL = f"""{TURN_BLOCKS}, {PARAGRAPHS}, {split_sql("SELECT conv_id || '/' || turn AS k, t FROM paragraphs", "k")},
 chunks AS (SELECT conv_id, role, p, q, trim(piece, chr(10)) AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, step) - 1 AS INTEGER) AS chunk_index FROM pieces JOIN paragraphs ON k = conv_id || '/' || turn)"""


@query(
    f"""WITH RECURSIVE {CHUNKS_SQL} SELECT {ID_SQL.format(stem="'conversation ' || conv_id", i="chunk_index", src="'conversation ' || conv_id || '.md'", c="content")} AS chunk_id, 'conversation ' || conv_id || '.md' AS source, chunk_index, p AS page_start, q AS page_end,
 2 AS heading_level, 'Conversation ' || conv_id AS topic, role AS subtopic, role AS section_title, 'Conversation ' || conv_id || ' > ' || role AS section, 'New York' AS region, 'conversations' AS energy_utility_name, content,
 {CONTENT_TYPE_SQL.replace("(c,", "(content,")} AS content_type, CAST(length(content) // 4 AS INTEGER) AS token_estimate FROM chunks"""
)
def chunk_documents(spark, sf_dir):
    rows = C.chunk_documents(inputs.markdown(spark, sf_dir))
    kept = ("chunk_id", "source", "chunk_index", "page_start", "page_end", "heading_level", "topic", "subtopic", "section_title", "section", "region", "energy_utility_name", "content", "content_type")
    return rows.select(*kept, F.col("metadata.token_estimate").alias("token_estimate"))


@query(
    """SELECT conv_id, string_agg(k || ': ' || v, chr(10) ORDER BY o) AS content FROM (SELECT conv_id, CASE turn WHEN 0 THEN 'PROCESS NAME' WHEN 1 THEN 'PROCESS NUMBER' ELSE 'Turn ' || turn END AS k, role AS v, CASE turn WHEN 0 THEN -1 WHEN 1 THEN -2 ELSE turn END AS o
 FROM conversations) GROUP BY conv_id"""
)
def process_table(spark, sf_dir):
    """All turns of every conversation as a process table: known keys first, then the others as they come."""
    key = F.when(F.col("turn") == 0, "PROCESS NAME:").when(F.col("turn") == 1, "PROCESS NUMBER").otherwise(F.concat(F.lit("Turn "), F.col("turn").cast("string")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<tr><td>"), key, F.lit("</td><td>"), "role", F.lit("</td></tr>")).alias("r"))
    html = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]), "\n").alias("r"))
    html = html.select("conv_id", F.concat(F.lit("<table>\n"), "r", F.lit("\n</table>")).alias("t"))
    return C.markdown_blocks(html, ["conv_id"], "t").select("conv_id", F.col("text").alias("content"))


@query("SELECT custkey, 'Key | ' || c_custkey || chr(10) || 'Name | ' || c_name || chr(10) || 'Segment | ' || c_mktsegment || ' | ' || n_name AS content FROM (SELECT c_custkey AS custkey, * FROM customer) JOIN nation ON c_nationkey = n_nationkey")
def generic_table(spark, sf_dir):
    """A table that is no process, with cells that hold tags and rows without text."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    text = lambda x: F.col(x).cast("string")
    html = F.concat(
        F.lit("<table>\n<tr><th>Key</th><td>"), text("c_custkey"), F.lit("</td></tr>\n<tr><td> </td></tr>\n<TR class='x'><td><b>Name</b></td><td>"),
        text("c_name"), F.lit("</td></TR>\n<tr><td>Segment</td><td>"), text("c_mktsegment"), F.lit("</td><td>"), text("n_name"), F.lit("</td></tr>\n</table>"),
    )
    rows = c.select(F.col("c_custkey").alias("custkey"), html.alias("t"))
    return C.markdown_blocks(rows, ["custkey"], "t").select("custkey", F.col("text").alias("content"))


@query("SELECT p_partkey, '[Figure Caption] ' || p_name || chr(10) || '[Figure Description] Part of ' || p_brand || chr(10) || '[Figure Content] ' || p_name || ' ' || p_type || ' and its price ' || p_size AS content FROM part")
def figure_text(spark, sf_dir):
    """A figure with caption, description and text of every part."""
    html = F.concat(F.lit("<figure>\n<figcaption>"), "p_name", F.lit("</figcaption>\n<!-- AI Description: Part  of\n "), "p_brand", F.lit(" -->\n"), "p_type", F.lit(" ✓ and <i>its</i> price "), F.col("p_size").cast("string"), F.lit("\n</figure>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", html.alias("t"))
    return C.markdown_blocks(rows, ["p_partkey"], "t").select("p_partkey", F.col("text").alias("content"))


PACK_SQL = f"""{TURN_BLOCKS}, {PARAGRAPHS}, pieces AS (SELECT conv_id, 2 * turn AS o, t, false AS atomic FROM paragraphs UNION ALL SELECT conv_id, 2 * turn + 1, '| ' || role || ' | ' || turn || ' |', true FROM conversations),
 p AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS i, t, atomic, length(t) AS n FROM pieces),
 walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS win, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS done FROM (SELECT DISTINCT conv_id FROM p)
 UNION ALL SELECT w.conv_id, p.i, CASE WHEN fits THEN CASE WHEN win = '' THEN t ELSE win || chr(10) || chr(10) || t END WHEN atomic OR tail = '' THEN t ELSE tail || chr(10) || chr(10) || t END,
 CASE WHEN fits THEN used + n WHEN atomic OR tail = '' THEN n ELSE length(tail) + 2 + n END, CASE WHEN fits THEN NULL ELSE win END
 FROM (SELECT *, {sql_strip("right(win, 320)")} AS tail FROM walk) w JOIN (SELECT * FROM p) p ON p.conv_id = w.conv_id AND p.i = w.i + 1, LATERAL (SELECT used + n <= 2400 OR (atomic AND win = '') AS fits)),
 windows AS (SELECT conv_id, i, 0 AS k, done AS content FROM walk WHERE done <> '' UNION ALL SELECT conv_id, i, 1, win FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS last FROM walk) WHERE i = last AND win <> '')"""


@query(f"WITH RECURSIVE {PACK_SQL} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i, k) - 1 AS INTEGER) AS chunk_index, {sql_strip('content')} AS content FROM windows")
def pack_sections(spark, sf_dir):
    """Windows over turns with a table after each: text that overflows takes a tail along, tables stay whole."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat("text", F.lit("\n| "), "role", F.lit(" | "), F.col("turn").cast("string"), F.lit(" |"))
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    docs = docs.select(F.col("conv_id").cast("string").alias("source"), F.lit("u").alias("utility"), "text")
    return C.chunk_documents(docs).select(F.col("source").cast("long").alias("conv_id"), "chunk_index", "content")


# Sessions

ROWS = SQL["session_rows"]


@query(
    f"""SELECT question, answer, cnt FROM (SELECT question, answer, row_number() OVER (PARTITION BY question ORDER BY created_at DESC, answer DESC) AS rn, count(*) OVER (PARTITION BY question) AS cnt
 FROM ({ROWS}) WHERE question <> '' AND answer <> '') WHERE rn = 1 ORDER BY cnt DESC, question LIMIT 50"""
)
def faq(spark, sf_dir):
    return S.faq(inputs.session_rows(spark, sf_dir))


@query(
    f"""SELECT session_id, msg_id, question, answer, feedback, created_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id, msg_id ORDER BY question <> '' DESC, created_at DESC, question DESC, answer DESC) AS n FROM ({ROWS})) WHERE n = 1"""
)
def session_dedupe(spark, sf_dir):
    return S.latest_rows(inputs.session_rows(spark, sf_dir))


UPDATES = "SELECT 's' || doc_id // 40 AS session_id, 'm' || (doc_id % 60) AS msg_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS feedback, doc_id AS seq FROM labels"


@query(
    f"""WITH r AS ({ROWS}), u AS (SELECT session_id AS s, msg_id AS m, arg_max(feedback, seq) AS f FROM ({UPDATES}) GROUP BY 1, 2)
 SELECT session_id, msg_id, question, answer, CASE WHEN s IS NULL THEN feedback ELSE f END AS feedback, created_at FROM r LEFT JOIN u ON session_id = s AND msg_id = m
 UNION ALL SELECT s, m, '', '', f, '{NOW}' FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE session_id = s AND msg_id = m)"""
)
def feedback_upsert(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    updates = labels.select(
        F.concat(F.lit("s"), F.expr("doc_id div 40").cast("string")).alias("session_id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 60).cast("string")).alias("msg_id"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("feedback"),
        F.col("doc_id").alias("seq"),
    )
    return S.upsert_feedback(inputs.session_rows(spark, sf_dir), updates, NOW)


FLAT_SQL = f"""SELECT 'c' || conv_id AS session_id, 'm' || turn AS msg_id, text AS question, answer, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'good, ok' ELSE '{{"r": 1, "t": "a,b"}}' END AS feedback, '{NOW}' AS created_at
 FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user'"""


@query(FLAT_SQL)
def session_flatten(spark, sf_dir):
    return S.flatten(inputs.blobs(spark, sf_dir), NOW)


@query(FLAT_SQL)
def backup_stream(spark, sf_dir):
    folder = shared_folder(spark)
    inputs.blobs(spark, sf_dir).write.text(f"{folder}/in")
    stream = spark.readStream.text(f"{folder}/in").withColumnRenamed("value", "raw")
    ingest.backup(stream, f"{folder}/out", f"{folder}/checkpoint", NOW)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("SELECT conv_id, 1 AS n_sessions, CAST(conv_id AS VARCHAR) AS first_id FROM conversations GROUP BY conv_id UNION ALL SELECT -1 - conv_id, 0, NULL FROM conversations GROUP BY conv_id")
def session_repair(spark, sf_dir):
    """Session files with noise around the list, and files without one."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    raw = ids.select("conv_id", F.concat(F.lit('noise [{"id":"'), F.col("conv_id").cast("string"), F.lit('"}]} tail')).alias("raw")).unionByName(ids.select((-1 - F.col("conv_id")).alias("conv_id"), F.lit("{broken").alias("raw")))
    got = raw.select("conv_id", S.repair_sessions(F.col("raw")).alias("s"))
    return got.select("conv_id", F.size("s").alias("n_sessions"), F.get_json_object(F.get("s", F.lit(0)), "$.id").alias("first_id"))


@query(
    f"""SELECT conv_id, string_agg(k || '=' || q || '/' || a || '/' || f || '/' || '{NOW}', ' ' ORDER BY o) AS messages FROM (
 SELECT conv_id, turn AS o, 'm' || turn AS k, md5(text) AS q, '' AS a, CASE WHEN conv_id % 2 = 0 AND turn = 2 THEN 'good' ELSE '-' END AS f FROM conversations
 UNION ALL SELECT conv_id, 1000000000, 'm2', md5(''), '', 'good' FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id HAVING count(*) FILTER (turn = 2) = 0
 UNION ALL SELECT conv_id, 1000000000, 'new', md5('q'), 'a', '-' FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id) GROUP BY conv_id"""
)
def attach_feedback(spark, sf_dir):
    """Feedback on message m2 of every second conversation, one more message in all others."""
    turns = table(spark, sf_dir, "conversations").withColumn("m", S.message(F.concat(F.lit("m"), F.col("turn").cast("string")), F.col("text"), F.lit(""), None, F.lit(NOW)))
    records = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("t")).select("conv_id", F.transform("t", lambda x: x["m"]).alias("messages"))
    rated = S.attach_feedback(F.col("messages"), F.lit("m2"), F.lit("good"), NOW)
    more = S.append_message(F.col("messages"), "new", "q", "a", NOW)
    out = records.select("conv_id", F.when(F.col("conv_id") % 2 == 0, rated).otherwise(more).alias("m"))
    said = F.transform("m", lambda x: F.concat(x["msgId"], F.lit("="), F.md5(x["question"].cast("binary")), F.lit("/"), x["answer"], F.lit("/"), F.coalesce(x["feedback"], F.lit("-")), F.lit("/"), x["created_at"]))
    return out.select("conv_id", F.array_join(said, " ").alias("messages"))


RECORDS = "SELECT conv_id, string_agg('m' || turn || '@' || CASE WHEN turn = (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id) THEN 'then' ELSE '' END, ' ' ORDER BY turn) AS messages FROM conversations c"


@query(f"{RECORDS} WHERE conv_id % 3 <> 2 GROUP BY conv_id UNION ALL SELECT conv_id, '' FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id")
def load_records(spark, sf_dir):
    """Records from a first store, else a second, else empty; the session's time goes to a first message without one."""
    turns = table(spark, sf_dir, "conversations").withColumn("m", S.message(F.concat(F.lit("m"), F.col("turn").cast("string")), F.col("text"), F.lit(""), None, F.lit("")))
    every = turns.groupBy(F.col("conv_id").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("t"))
    store = every.select("session_id", F.lit("then").alias("created_at"), F.transform("t", lambda x: x["m"]).alias("messages"))
    first, second = store.where("session_id % 3 = 0"), store.where("session_id % 3 <= 1")
    got = S.load_records(every, first, second)
    return got.select(F.col("session_id").alias("conv_id"), F.array_join(F.transform("messages", lambda m: F.concat(m["msgId"], F.lit("@"), m["created_at"])), " ").alias("messages"))


@query("SELECT DISTINCT session_id, msg_id FROM (SELECT 's' || doc_id // 40 AS session_id, 'm' || (doc_id % 60) AS msg_id FROM labels) k WHERE EXISTS (SELECT 1 FROM (" + ROWS + ") r WHERE r.session_id = k.session_id AND r.msg_id = k.msg_id)")
def has_message(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").select(F.concat(F.lit("s"), F.expr("doc_id div 40").cast("string")).alias("session_id"), F.concat(F.lit("m"), (F.col("doc_id") % 60).cast("string")).alias("msg_id")).distinct()
    return S.has_message(inputs.session_rows(spark, sf_dir), keys)


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}-]', '_', 'g') || '.json' AS file FROM pages")
def session_file(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.session_file(F.col("url")).alias("file"))


@query("SELECT CAST(conv_id AS VARCHAR) AS id, conv_id AS position, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE 'old' END AS payload FROM conversations GROUP BY conv_id UNION ALL SELECT 'x' || conv_id, (SELECT max(conv_id) FROM conversations) + 1 + conv_id, 'new' FROM conversations GROUP BY conv_id")
def put_sessions(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    old = ids.select(F.col("conv_id").cast("string").alias("id"), F.col("conv_id").alias("position"), F.lit("old").alias("payload"))
    new = lambda name, seq: ids.select(name.alias("id"), F.lit("new").alias("payload"), seq.alias("seq"))
    number = F.col("conv_id").cast("string")
    updates = new(number, F.col("conv_id")).where("id % 2 = 0").unionByName(new(F.concat(F.lit("x"), number), F.col("conv_id")))
    return S.put_sessions(old, updates)


# Listings

PATHS = SQL["paths"]
FILES = f"SELECT split_part(path, '/', 1) AS client, substr(path, strpos(path, '/') + 1) AS file, mtime, size FROM ({PATHS}) WHERE strpos(path, '/') > 0"
PLAIN = f"SELECT * FROM ({FILES}) WHERE file NOT IN ('', '.keep') AND strpos(file, '/') = 0"


@query(f"SELECT DISTINCT client FROM ({FILES})")
def list_clients(spark, sf_dir):
    return files.clients(inputs.paths(spark, sf_dir))


@query(f"SELECT client, file FROM ({PLAIN}) WHERE file NOT LIKE 'read-%'")
def list_uploaded(spark, sf_dir):
    return files.uploaded_files(inputs.paths(spark, sf_dir))


@query(f"SELECT client, substr(file, 6) AS file FROM ({PLAIN}) WHERE file LIKE 'read-%'")
def list_processed(spark, sf_dir):
    return files.processed_files(inputs.paths(spark, sf_dir))


@query(f"SELECT DISTINCT client, regexp_replace(file, '^read-', '') AS file FROM ({PLAIN})")
def list_all_files(spark, sf_dir):
    return files.all_files(inputs.paths(spark, sf_dir))


@query(
    f"""WITH f AS ({PLAIN}), w AS (SELECT source AS client, doc_id || '.pdf' AS file FROM documents WHERE source IS NOT NULL)
 SELECT w.client, w.file, w.client || '/' || CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.client = w.client AND f.file = w.file) THEN w.file ELSE 'read-' || w.file END AS path, 'application/pdf' AS mime FROM w
 WHERE EXISTS (SELECT 1 FROM f WHERE f.client = w.client AND f.file IN (w.file, 'read-' || w.file))"""
)
def view_files(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("client"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"))
    return files.view_files(wanted, inputs.paths(spark, sf_dir))


MANIFEST = "SELECT path AS file, mtime, CASE WHEN mtime % 7 = 0 THEN size + 1 ELSE size END AS size FROM ({}) WHERE mtime % 2 = 0"


@query(f"SELECT file, mtime, size FROM (SELECT path AS file, mtime, size FROM ({PATHS})) l WHERE NOT EXISTS (SELECT 1 FROM ({MANIFEST.format(PATHS)}) m WHERE m.file = l.file AND m.mtime = l.mtime AND m.size = l.size)")
def pending_files(spark, sf_dir):
    listed = inputs.paths(spark, sf_dir).withColumnRenamed("path", "file")
    manifest = listed.where("mtime % 2 = 0").withColumn("size", F.expr("CASE WHEN mtime % 7 = 0 THEN size + 1 ELSE size END"))
    return files.pending_files(listed, manifest)


@query(f"SELECT DISTINCT lang || '/.keep' AS path FROM documents WHERE lang IS NOT NULL UNION SELECT source || '/.keep' FROM documents WHERE source || '/.keep' NOT IN (SELECT path FROM ({PATHS}))")
def new_clients(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.select(F.col("lang").alias("client")).union(docs.select("source")).where("client is not null")
    return files.new_clients(names, inputs.paths(spark, sf_dir))


@query(f"SELECT file FROM (SELECT path AS file, mtime FROM ({PATHS})) WHERE file NOT IN (SELECT path FROM ({PATHS}) WHERE mtime % 3 = 0)")
def sync_missing(spark, sf_dir):
    remote = inputs.paths(spark, sf_dir).select(F.col("path").alias("file"), "mtime")
    return files.missing_locally(remote, remote.where("mtime % 3 = 0")).select("file")


# Layout

LAYOUT = SQL["layout"]
PAGES = f"""lay AS ({LAYOUT}), raw AS (SELECT doc_id, content, n, unnest(range(n)) AS i FROM lay),
 own AS (SELECT *, CASE WHEN i % 4 = 3 THEN (i - 1) * 1000 + greatest(least(990, length(content) - (i - 1) * 1000), 0) + 1 ELSE i * 1000 END AS s FROM raw),
 pages AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_number, CAST(s AS INTEGER) AS page_start, CAST(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), length(content)) AS INTEGER) AS page_end, content AS whole FROM own),
 paras AS (SELECT doc_id, CAST(j AS INTEGER) AS paragraph_no, j * 700 AS a, j * 700 + greatest(least(650, length(content) - j * 700), 0) AS b FROM (SELECT doc_id, content, unnest(range(np)) AS j FROM lay))"""


@query(f"WITH {PAGES} SELECT doc_id, page_number, page_start, page_end FROM pages")
def page_ranges(spark, sf_dir):
    return L.page_ranges(inputs.layout(spark, sf_dir)).drop("content")


@query(f"WITH {PAGES} SELECT doc_id, page_number, substr(whole, page_start + 1, greatest(page_end - page_start, 0)) AS content FROM pages")
def page_slices(spark, sf_dir):
    return L.page_ranges(inputs.layout(spark, sf_dir)).select("doc_id", "page_number", "content")


@query(f"WITH {PAGES} SELECT doc_id, page_number, paragraph_no FROM pages JOIN paras USING (doc_id) WHERE a < page_end AND b > page_start")
def span_overlap_join(spark, sf_dir):
    return L.paragraphs_on_page(inputs.layout(spark, sf_dir))


@query(f"WITH lay AS ({LAYOUT}), t AS (SELECT doc_id, n, unnest(range((n - 1) // 3 + 1)) AS k FROM lay) SELECT doc_id, CAST(p AS INTEGER) AS page_number, CAST(k AS INTEGER) AS table_no FROM (SELECT doc_id, n, k, unnest([k * 3 + 1, k * 3 + 2]) AS p FROM t) WHERE p <= n")
def tables_on_page(spark, sf_dir):
    return L.tables_on_page(inputs.layout(spark, sf_dir))


@query(f"SELECT doc_id, n AS total_pages, CAST((n - 1) // 3 + 1 AS INTEGER) AS total_tables, np AS total_paragraphs FROM ({LAYOUT})")
def layout_totals(spark, sf_dir):
    return L.totals(inputs.layout(spark, sf_dir))


MD_TABLE = """rws AS (SELECT r_regionkey, r_name, CAST(n_nationkey AS VARCHAR) AS k, n_name || ' \\|x' AS v, n_nationkey AS o FROM region JOIN nation ON r_regionkey = n_regionkey),
 wid AS (SELECT r_regionkey, r_name, greatest(3, max(length(k))) AS a, greatest(3, length(r_name), max(length(v))) AS b FROM rws GROUP BY r_regionkey, r_name),
 md AS (SELECT r_regionkey, '| ' || rpad('key', CAST(a AS INTEGER), ' ') || ' | ' || rpad(wid.r_name, CAST(b AS INTEGER), ' ') || ' |     |' || chr(10) || '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' | --- |' || chr(10) ||
 string_agg('| ' || rpad(k, CAST(a AS INTEGER), ' ') || ' | ' || rpad(v, CAST(b AS INTEGER), ' ') || ' |     |', chr(10) ORDER BY o) AS md FROM wid JOIN rws USING (r_regionkey) GROUP BY r_regionkey, wid.r_name, a, b)"""


@query(f"WITH {MD_TABLE} SELECT r_regionkey, md FROM md")
def html_table_to_markdown(spark, sf_dir):
    return inputs.html_tables(spark, sf_dir).select("r_regionkey", L.html_table_to_markdown(F.col("html")).alias("md"))


CELLS = """cells AS (SELECT page_id, regexp_replace(regexp_replace(url, '\\s+', ' ', 'g'), '\\|', '\\\\|', 'g') AS a, CAST(length(html) AS VARCHAR) AS b FROM pages)"""
DRAWN = """'| url' || repeat(' ', greatest(length(a), 3) - 3) || ' | size' || repeat(' ', greatest(length(b), 4) - 4) || ' |' || chr(10) || '| ' || repeat('-', greatest(length(a), 3)) || ' | ' || repeat('-', greatest(length(b), 4)) || ' |' || chr(10) ||
 '| ' || a || repeat(' ', greatest(length(a), 3) - length(a)) || ' | ' || b || repeat(' ', greatest(length(b), 4) - length(b)) || ' |'"""


@query(f"WITH {MD_TABLE}, {CELLS} SELECT 'r' || r_regionkey AS id, true AS updated, 'before ' || md || ' after' AS html FROM md UNION ALL SELECT 'p' || page_id, true, html || {DRAWN} || 'tail' FROM cells JOIN pages USING (page_id) UNION ALL SELECT 'q' || page_id, false, html FROM pages")
def convert_tables(spark, sf_dir):
    """Tables of the regions, all pages with a table after them, and all pages as they are."""
    pages = table(spark, sf_dir, "pages")
    more = F.concat(F.lit("<table><tr><th>url</th><th>size</th></tr>\n<tr><td>"), "url", F.lit("</td><td>"), F.length("html").cast("string"), F.lit("</td></tr></table>tail"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    rows = inputs.html_tables(spark, sf_dir).select(name("r", "r_regionkey"), "html")
    rows = rows.unionByName(pages.select(name("p", "page_id"), F.concat("html", more).alias("html"))).unionByName(pages.select(name("q", "page_id"), "html"))
    return L.reprocess(rows, "html").select("id", "updated", "html")


# Embedding and index state

VECTORS = SQL["vectors"]
CHUNKS = "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS energy_utility_name, strpos(coalesce(text, ''), '|') > 0 AS has_table, doc_id % 4 = 0 AS has_figure FROM documents"
UPLOADS = "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, quality = 1 AS uploaded FROM labels"


def _chunks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("energy_utility_name"), F.contains(F.coalesce("text", F.lit("")), F.lit("|")).alias("has_table"), (F.col("doc_id") % 4 == 0).alias("has_figure"))


def _uploads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"), (F.col("quality") == 1).alias("uploaded"))


def checksum(v: str) -> Column:
    """Every component of a vector, by its place."""
    return F.round(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4)


CHECKSUM = "round(list_sum(list_transform(range(1, len({v}) + 1), lambda i: CAST(list_extract({v}, i) AS DOUBLE) * i)), 4)"


@query(f"SELECT chunk_id, {CHECKSUM.format(v='v')} AS checksum, CAST(len(v) AS INTEGER) AS dim FROM (SELECT chunk_id, arg_max(vector, seq) AS v FROM ({VECTORS}) GROUP BY chunk_id)")
def latest_vector(spark, sf_dir):
    v = I.latest_vectors(inputs.vectors(spark, sf_dir))
    return v.select("chunk_id", checksum("vector").alias("checksum"), F.size("vector").alias("dim"))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS chunk_id, vec_id AS seq, {CHECKSUM.format(v='embedding')} AS checksum FROM embeddings WHERE vec_id < (SELECT max(vec_id) - 9 FROM embeddings)")
def vector_lines(spark, sf_dir):
    """Lines of a cache that has a broken line near its end: what follows is not read."""
    v = table(spark, sf_dir, "embeddings")
    last = v.agg(F.max("vec_id")).first()[0] or 0
    good = F.to_json(F.struct(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector")))
    lines = v.select(F.col("vec_id").alias("seq"), F.when(F.col("vec_id") == last - 9, '{"chunk_id": "x", "vec').otherwise(good).alias("line"))
    return I.vector_lines(lines).select("chunk_id", "seq", checksum("vector").alias("checksum"))


@query(f"SELECT chunk_id FROM ({CHUNKS}) WHERE chunk_id NOT IN (SELECT chunk_id FROM ({VECTORS}))")
def pending_embed(spark, sf_dir):
    return I.pending_embed(_chunks(spark, sf_dir), inputs.vectors(spark, sf_dir)).select("chunk_id")


@query(f"SELECT chunk_id FROM ({CHUNKS}) WHERE chunk_id NOT IN (SELECT chunk_id FROM ({UPLOADS}) WHERE uploaded)")
def pending_upload(spark, sf_dir):
    return I.pending_upload(_chunks(spark, sf_dir), _uploads(spark, sf_dir)).select("chunk_id")


@query(
    f"""SELECT (SELECT count(*) FROM ({CHUNKS})) AS chunks, (SELECT count(*) FROM ({CHUNKS}) WHERE has_table) AS with_tables, (SELECT count(*) FROM ({CHUNKS}) WHERE has_figure) AS with_figures,
 (SELECT string_agg(DISTINCT energy_utility_name, ',' ORDER BY energy_utility_name) FROM ({CHUNKS})) AS utilities, (SELECT count(DISTINCT chunk_id) FROM ({VECTORS})) AS vectors_cached, (SELECT count(*) FROM ({UPLOADS}) WHERE uploaded) AS uploaded"""
)
def index_stats(spark, sf_dir):
    return I.stats(_chunks(spark, sf_dir), inputs.vectors(spark, sf_dir), _uploads(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN md5('new' || coalesce(text, '')) ELSE md5(coalesce(text, '')) END AS state FROM documents UNION ALL SELECT 'n' || doc_id, md5(coalesce(text, '')) FROM documents")
def index_upsert(spark, sf_dir):
    """A third of the documents again with other content, and every one under a new id."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.md5(text.cast("binary")).alias("state"), F.md5(F.concat(F.lit("new"), text).cast("binary")).alias("later"))
    new = d.where("doc_id % 3 = 0").select("chunk_id", F.col("later").alias("state")).union(d.select(F.concat(F.lit("n"), "chunk_id"), "state"))
    return I.upsert(d.select("chunk_id", "state"), new)


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS t FROM documents), p AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS place, sum(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) < 8 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2)
 SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(place AS INTEGER) AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 4) AS value FROM p WHERE v <> 0"""
)
def embed_chunks(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    v = I.embed(chunks, kind="double").select("chunk_id", F.posexplode("vector").alias("place", "value"))
    return v.where("value <> 0").withColumn("value", F.round("value", 4))


def _embedded_chunks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chunks, made once, and a vector for each."""
    chunks = written(C.chunk_documents(inputs.markdown(spark, sf_dir)))
    index = F.col("chunk_index")
    return chunks, chunks.select("chunk_id", F.array(index + 0.5, F.length("content") / 2).cast("array<float>").alias("vector"), index.alias("seq"))


CHUNK_ID = ID_SQL.format(stem="'conversation ' || conv_id", i="chunk_index", src="'conversation ' || conv_id || '.md'", c="content")


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT {CHUNK_ID} AS chunk_id, p AS page_start, q AS page_end, md5(content) AS content, '{{\"char_count\": ' || length(content) || ', \"token_estimate\": ' || length(content) // 4 || '}}' AS metadata_json, chunk_index + 0.5 AS v0, length(content) / 2 AS v1 FROM chunks")
def index_document(spark, sf_dir):
    rows = I.index_documents(*_embedded_chunks(spark, sf_dir))
    at = lambda k: F.get("content_vector", F.lit(k)).cast("double").alias(f"v{k}")
    return rows.select("chunk_id", "page_start", "page_end", F.md5(F.col("content").cast("binary")).alias("content"), "metadata_json", at(0), at(1))


@query(f"WITH RECURSIVE {CHUNKS_SQL}, ids AS (SELECT {CHUNK_ID} AS chunk_id, chunk_index FROM chunks WHERE conv_id % 2 = 0) SELECT chunk_id, chunk_index % 2 = 0 AS found FROM ids UNION ALL SELECT 'x' || item_id, false FROM benchmark")
def reindex_subset(spark, sf_dir):
    """Ids of half the conversations' chunks, every second of which has a vector, and ids that no chunk has."""
    chunks, vectors = _embedded_chunks(spark, sf_dir)
    ids = chunks.where("cast(regexp_extract(source, '([0-9]+)', 1) as long) % 2 = 0").select("chunk_id").union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("x"), F.col("item_id").cast("string"))))
    rows, missing = I.reindex(ids, chunks, vectors.where("seq % 2 = 0"))
    return rows.select("chunk_id", F.lit(True).alias("found")).union(missing.select("chunk_id", F.lit(False)))


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT {CHUNK_ID} AS chunk_id, chunk_index % 3 <> 0 AS embedded_now, CASE WHEN chunk_index % 3 = 0 THEN chunk_index + 0.5 ELSE -1 END AS v0 FROM chunks WHERE chunk_index % 5 <> 0")
def run_pipeline(spark, sf_dir):
    """Of all chunks a fifth is uploaded already and a third has a vector: what is embedded, indexed and marked now."""
    chunks, vectors = _embedded_chunks(spark, sf_dir)
    uploads = chunks.where("chunk_index % 5 = 0").select("chunk_id", F.lit(True).alias("uploaded"))
    made, rows, marks = I.run_pipeline(chunks, vectors.where("seq % 3 = 0"), uploads)
    rows = rows.join(made.select("chunk_id", F.lit(True).alias("now")), "chunk_id", "left").join(marks, "chunk_id").where("uploaded")
    return rows.select("chunk_id", F.coalesce("now", F.lit(False)).alias("embedded_now"), F.when(F.col("now"), -1.0).otherwise(F.get("content_vector", F.lit(0)).cast("double")).alias("v0"))


# Retrieval

INDEX = SQL["index"]
TERMS = "['applies', 'general', 'license', 'public', 'the', 'to', 'version', 'which', 'work']"


def bm25_sql(source: str, key: str = "chunk_id") -> str:
    """CTE bm25(key, score) over ``source`` (key, t)."""
    return f"""tok AS MATERIALIZED (SELECT {key}, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({source})), len AS (SELECT {key}, len(w) AS dl FROM tok), av AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
 tf AS (SELECT {key}, term, count(*) AS f FROM (SELECT {key}, unnest(w) AS term FROM tok) WHERE list_contains({TERMS}, term) GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
 bm25 AS (SELECT {key}, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING ({key}) CROSS JOIN av GROUP BY {key})"""


def cosine_sql(source: str) -> str:
    q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
    return f"near AS (SELECT chunk_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM (SELECT chunk_id, CAST(content_vector AS DOUBLE[]) AS v, {q} AS q FROM ({source}) WHERE content_vector IS NOT NULL))"


def top(name: str, k: int) -> str:
    return f"SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {name} ORDER BY score DESC, chunk_id LIMIT {k}"


def _question(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


SEARCHED = "SELECT chunk_id, concat_ws(' ', section_title, topic, subtopic, content) AS t FROM ({})"
RRF = """fused AS (SELECT chunk_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 6) AS score FROM lex a FULL JOIN vec b USING (chunk_id))"""


def hybrid_sql(source: str, k: int) -> str:
    return f"{bm25_sql(SEARCHED.format(source))}, {cosine_sql(source)}, lex AS ({top('bm25', 2 * k)}), vec AS ({top('near', 2 * k)}), {RRF}, hits AS ({top('fused', k)})"


@query(f"WITH {cosine_sql(INDEX)} {top('near', 30)}")
def vector_topk(spark, sf_dir):
    return R.vector_topk(inputs.index(spark, sf_dir), _question(spark, sf_dir), 30)


@query(f"WITH {bm25_sql(SEARCHED.format(INDEX))} {top('bm25', 30)}")
def bm25_topk(spark, sf_dir):
    return R.bm25_topk(inputs.index(spark, sf_dir), QUESTION, 30, text=R.searchable())


@query(f"WITH {bm25_sql(SEARCHED.format(INDEX))} {top('bm25', 30)}")
def bm25_stored(spark, sf_dir):
    """The same from a stored index of terms, which is written first."""
    folder = shared_folder(spark)
    R.write_postings(inputs.index(spark, sf_dir), folder, text=R.searchable())
    return R.bm25_stored_topk(spark, folder, QUESTION, 30)


SHOWN = "chunk_id, hits.score AS _score, hits.rank AS _rank, i.source, source_pdf_name, chunk_index, page_start, page_end, topic, subtopic, section_title, section, md5(content) AS content, content_type"


def _shown(hits: DataFrame) -> DataFrame:
    names = [c.strip() for c in SHOWN.split("i.source, ")[1].split(",") if " AS " not in c]
    return hits.select("chunk_id", "_score", "_rank", "source", *names, F.md5(F.col("content").cast("binary")).alias("content"))


@query(f"WITH {hybrid_sql(INDEX, 15)} SELECT {SHOWN} FROM hits JOIN ({INDEX}) i USING (chunk_id)")
def hybrid_rrf(spark, sf_dir):
    return _shown(R.hybrid_search(inputs.index(spark, sf_dir), QUESTION, _question(spark, sf_dir)))


KEPT = f"SELECT * FROM ({INDEX}) WHERE content_type = 'text' AND source_pdf_name = (SELECT source || '.pdf' FROM documents WHERE doc_id = 1)"


@query(f"WITH {hybrid_sql(KEPT, 10)} SELECT {SHOWN} FROM hits JOIN ({INDEX}) i USING (chunk_id)")
def filtered_search(spark, sf_dir):
    source = table(spark, sf_dir, "documents").where("doc_id = 1").first().source
    hits = R.hybrid_search(inputs.index(spark, sf_dir), QUESTION, _question(spark, sf_dir), 10, " TEXT ", f"{source}.pdf")
    return _shown(hits)


SCORED = f"scored AS (SELECT hits.*, i.*, len(list_intersect(regexp_extract_all(lower(substr(content, 1, 400)), '[\\p{{L}}\\p{{N}}]+'), {TERMS})) / 9.0 AS s FROM hits JOIN ({INDEX}) i USING (chunk_id))"


@query(f"WITH {hybrid_sql(INDEX, 15)}, {SCORED} SELECT chunk_id, round(s, 6) AS _rerank_score, rank AS _rank FROM scored ORDER BY s DESC, rank LIMIT 8")
def rerank_topn(spark, sf_dir):
    hits = R.hybrid_search(inputs.index(spark, sf_dir), QUESTION, _question(spark, sf_dir))
    return R.rerank(hits, R.coverage(QUESTION), 8).select("chunk_id", F.round("_rerank_score", 6).alias("_rerank_score"), "_rank")


def context_sql(source: str, order: str) -> str:
    """context of ``source``, a CTE of hits."""
    return f"""SELECT string_agg('[SOURCE ' || n || '] [' || upper(content_type) || '] ' || section || CASE WHEN coalesce(page_start, 0) = 0 THEN '' WHEN page_start = page_end THEN '  (Page ' || page_start || ')' ELSE '  (Pages ' || page_start || '–' || page_end || ')' END || chr(10) || content || chr(10), chr(10) || '---' || chr(10) ORDER BY n) AS context
 FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN strpos(lower(source_pdf_name), 'esco doc') > 0 THEN 0 ELSE 1 END, {order}) AS n FROM {source})"""


@query(f"WITH {hybrid_sql(INDEX, 15)}, {SCORED}, best AS (SELECT * FROM scored ORDER BY s DESC, rank LIMIT 15) {context_sql('best', 's DESC, rank')}")
def build_context(spark, sf_dir):
    hits = R.hybrid_search(inputs.index(spark, sf_dir), QUESTION, _question(spark, sf_dir))
    return R.build_context(R.rerank(hits, R.coverage(QUESTION)), [F.desc("_rerank_score"), "_rank"])


@query(f"SELECT content_type AS value, count(*) AS n FROM ({INDEX}) GROUP BY content_type")
def facet_counts(spark, sf_dir):
    return I.facets(inputs.index(spark, sf_dir), "content_type")


@query("SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN NULL ELSE source END AS value FROM documents")
def normalize_filter(spark, sf_dir):
    said = F.array(*map(F.lit, (" NULL ", "string", "", "None", "\tunknown\n")))
    raw = F.when(F.col("doc_id") % 7 < 5, F.get(said, (F.col("doc_id") % 7).cast("int"))).otherwise(F.concat(F.lit("  "), "source", F.lit("\t")))
    return table(spark, sf_dir, "documents").select("doc_id", R.normalized(raw).alias("value"))


HISTORY = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations"


def _history(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("history"))
    return turns


@query(f"SELECT conv_id, string_agg(upper(role) || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS recent, CASE conv_id % 3 WHEN 0 THEN 'from json' WHEN 1 THEN 'bare words' ELSE 'the question' END AS refined FROM ({HISTORY}) WHERE back <= 4 GROUP BY conv_id")
def refine_query(spark, sf_dir):
    reply = F.when(F.col("conv_id") % 3 == 0, '{"standalone_query": "from json"}').when(F.col("conv_id") % 3 == 1, ' "bare words" ').otherwise('""')
    return _history(spark, sf_dir).select("conv_id", R.recent_conversation(F.col("history")).alias("recent"), R.refined(reply, F.lit("the question")).alias("refined"))


@query(
    f"""SELECT conv_id, CAST(count(*) + 2 AS INTEGER) AS n, md5('system: be exact' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) ||
 'user: Use the following source chunks to answer the question.' || chr(10) || chr(10) || '=== SOURCE CHUNKS ===' || chr(10) || 'context ' || conv_id || chr(10) || chr(10) || '=== QUESTION ===' || chr(10) || 'q') AS contents FROM ({HISTORY}) WHERE back <= 6 GROUP BY conv_id"""
)
def answer_messages(spark, sf_dir):
    context = F.concat(F.lit("context "), F.col("conv_id").cast("string"))
    m = _history(spark, sf_dir).select("conv_id", R.answer_messages("be exact", F.col("history"), context, F.lit("q")).alias("m"))
    every = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return m.select("conv_id", F.size("m").alias("n"), F.md5(every.cast("binary")).alias("contents"))


NULLS = f"SELECT * REPLACE (CASE WHEN chunk_index % 3 = 0 THEN NULL ELSE section END AS section, CASE WHEN chunk_index % 5 = 0 THEN NULL ELSE content_type END AS content_type, CASE WHEN chunk_index % 7 = 0 THEN NULL ELSE content END AS content) FROM ({INDEX})"


@query(
    f"""SELECT topic, string_agg('[SOURCE ' || n || '] [' || upper(coalesce(content_type, 'text')) || '] ' || coalesce(section, section_title, '') || CASE WHEN page_start = 0 THEN '' WHEN page_start = page_end THEN '  (Page ' || page_start || ')' ELSE '  (Pages ' || page_start || '–' || page_end || ')' END || chr(10) || coalesce(content, '') || chr(10), chr(10) || '---' || chr(10) ORDER BY n) AS context
 FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN strpos(lower(source_pdf_name), 'esco doc') > 0 THEN 0 ELSE 1 END, chunk_index) AS n FROM ({NULLS}) WHERE topic = (SELECT min(source) FROM documents)) GROUP BY topic"""
)
def context_of_nulls(spark, sf_dir):
    """All documents of the first source as hits, some without section, type or content: none is lost."""
    at = F.col("chunk_index")
    ix = inputs.index(spark, sf_dir)
    first = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    hits = ix.where(F.col("topic") == first).withColumns({"section": F.when(at % 3 != 0, F.col("section")), "content_type": F.when(at % 5 != 0, F.col("content_type")), "content": F.when(at % 7 != 0, F.col("content")), "_rank": at})
    return R.build_context(hits).select(F.lit(first).alias("topic"), "context")


PIECES_SQL = f"""{SPLIT_SQL}, numbered AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS i, piece FROM pieces),
 ix AS (SELECT {ID_SQL.format(stem="CAST(doc_id AS VARCHAR)", i="i", src="doc_id || '.md'", c="piece")} AS chunk_id, doc_id || '.md' AS source, '' AS source_pdf_name, source AS section, 0 AS page_start, 0 AS page_end, piece AS content FROM numbered JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
 typed AS (SELECT *, {CONTENT_TYPE_SQL.replace("(c,", "(content,")} AS content_type FROM ix)"""


@query(f"WITH RECURSIVE {PIECES_SQL}, {bm25_sql('SELECT chunk_id, content AS t FROM ix')}, lex AS ({top('bm25', 15)}), best AS (SELECT * FROM lex JOIN typed USING (chunk_id)) {context_sql('best', 'rank')}")
def retrieval_context(spark, sf_dir):
    """Documents cut to overlapping pieces, ranked for a question, the best as numbered sources."""
    docs = spread(table(spark, sf_dir, "documents"))
    # an index is a table: it is cut once and then read by column
    pieces = written(C.split_documents(docs, ["doc_id", "source"]))
    name, content = F.concat(F.col("doc_id").cast("string"), F.lit(".md")), F.col("content")
    rows = pieces.select(T.chunk_id(name, F.col("piece_no"), content).alias("chunk_id"), name.alias("source"), F.lit("").alias("source_pdf_name"), F.col("source").alias("section"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), "content")
    best = R.bm25_topk(rows, QUESTION, R.TOP_K).withColumnRenamed("rank", "_rank").drop("score")
    hits = rows.join(F.broadcast(best), "chunk_id")  # TOP_K rows
    return R.build_context(hits.withColumn("content_type", T.content_type(content)))


@query(ORACLES["chunk_documents"])
def ingest_stream(spark, sf_dir):
    """The chunks of a stream of documents, the same as of the batch."""
    folder = shared_folder(spark)
    inputs.markdown(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("source string, utility string, text string").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    ingest.ingest(stream, f"{folder}/out", f"{folder}/checkpoint")
    rows = ingest.latest_chunks(spark, f"{folder}/out")
    kept = ("chunk_id", "source", "chunk_index", "page_start", "page_end", "heading_level", "topic", "subtopic", "section_title", "section", "region", "energy_utility_name", "content", "content_type")
    return rows.select(*kept, F.col("metadata.token_estimate").alias("token_estimate"))
