"""Layout results to pages, and HTML tables to Markdown; DataFrame functions only.

A layout row is (doc_id, content, pages, tables, paragraphs) of type ``LAYOUT``.
Offsets count code points of ``content``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import squeeze

SPAN = "struct<offset:int,length:int>"
LAYOUT = (
    f"doc_id long, content string, pages array<struct<words:array<struct<span:{SPAN}>>,lines:array<struct<spans:array<{SPAN}>>>>>, "
    f"tables array<struct<boundingRegions:array<struct<pageNumber:int>>>>, paragraphs array<struct<content:string,spans:array<{SPAN}>>>"
)
BUCKET = 4096
# What counts as a table, a row, a cell, and as noise of pages inside a table.
ROW = r"(?isu)<tr[^>]*>(.*?)</tr>"
CELL = r"(?isu)<t[dh][^>]*>(.*?)</t[dh]>"
TABLE = r"(?isu)<table[^>]*>.*?</table>"
NOISE = ((r'<!--\s*PageNumber="[^"]+"\s*-->', ""), (r"<!--\s*Page\s*\d+\s*-->", ""), (r"\n\s*---\s*\n", "\n"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def page_ranges(layout: DataFrame) -> DataFrame:
    """doc_id, page_number, page_start, page_end, content: each page up to the start of the next."""
    ends = lambda s: F.filter(F.array(s["offset"], s["offset"] + s["length"]), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<span:struct<offset:int,length:int>>>")
    no_lines = F.array().cast("array<struct<spans:array<struct<offset:int,length:int>>>>")

    def offsets(p: Column) -> Column:
        words = F.flatten(F.transform(F.coalesce(p["words"], none), lambda w: ends(w["span"])))
        spans = F.flatten(F.transform(F.coalesce(p["lines"], no_lines), lambda x: x["spans"]))
        return F.concat(words, F.flatten(F.transform(spans, ends)))

    def add(acc: Column, p: Column) -> Column:
        def own(o: Column) -> Column:
            after = F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"] + 1, F.lit(0))
            empty = F.size(o) == 0
            start = F.when(empty, after).otherwise(F.array_min(o))
            return F.struct(start.alias("start"), F.when(empty, after).otherwise(F.array_max(o)).alias("stop"))

        return F.concat(acc, F.array(let(offsets(p), own)))

    ranges = F.aggregate("pages", F.array().cast("array<struct<start:int,stop:int>>"), add)

    def cut(r: Column) -> Column:
        """Each page with its own slice, so that the whole content is on no row of a page."""

        def page(p: Column, n: Column) -> Column:
            end = F.coalesce(F.get(r, n + 1)["start"], F.length("content"))
            return let(end, lambda e: F.struct((n + 1).alias("page_number"), p["start"].alias("page_start"), e.alias("page_end"), F.substring("content", p["start"] + 1, e - p["start"]).alias("content")))

        return F.transform(r, page)

    return layout.select("doc_id", F.explode(let(ranges, cut)).alias("p")).select("doc_id", "p.*")


def tables_on_page(layout: DataFrame) -> DataFrame:
    """doc_id, page_number, table_no for every page that one of the table's regions names."""
    regions = layout.select("doc_id", F.size("pages").alias("last"), F.posexplode("tables").alias("table_no", "t"))
    pages = F.array_distinct(F.transform(F.col("t.boundingRegions"), lambda r: r["pageNumber"]))
    return regions.select("doc_id", "table_no", "last", F.explode(pages).alias("page_number")).where("page_number between 1 and last").select("doc_id", "page_number", "table_no")


def interval_join(ranges: DataFrame, spans: DataFrame, key: str, bucket: int = BUCKET) -> DataFrame:
    """Pairs of (key, r_id, r_start, r_end) and (key, s_id, s_start, s_end) with s_start < r_end and s_end > r_start.

    Both sides are dealt to the buckets of positions that they touch and meet by
    equality; a pair counts in the first bucket that both touch.
    """
    touch = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(a, b) / bucket))
    left = ranges.withColumn("bucket", F.explode(touch("r_start", "r_end")))
    right = spans.withColumn("bucket", F.explode(touch("s_start", "s_end")))
    first = F.floor(F.greatest("r_start", "s_start") / bucket)
    return left.join(right, [key, "bucket"]).where((F.col("s_start") < F.col("r_end")) & (F.col("s_end") > F.col("r_start")) & (F.col("bucket") == first)).drop("bucket")


def paragraphs_on_page(layout: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, page_number, paragraph_no: some span of the paragraph overlaps the page."""
    ranges = page_ranges(layout).select("doc_id", F.col("page_number").alias("r_id"), F.col("page_start").alias("r_start"), F.col("page_end").alias("r_end"))
    spans = layout.select("doc_id", F.posexplode("paragraphs").alias("s_id", "p")).select("doc_id", "s_id", F.explode("p.spans").alias("s"))
    start = F.coalesce("s.offset", F.lit(0))
    spans = spans.select("doc_id", "s_id", start.alias("s_start"), (start + F.coalesce("s.length", F.lit(0))).alias("s_end"))
    pairs = interval_join(ranges, spans, "doc_id", bucket)
    return pairs.select("doc_id", F.col("r_id").alias("page_number"), F.col("s_id").alias("paragraph_no")).distinct()


def totals(layout: DataFrame) -> DataFrame:
    return layout.select("doc_id", *[F.coalesce(F.size(c), F.lit(0)).alias(f"total_{c}") for c in ("pages", "tables", "paragraphs")])


def html_table_to_markdown(html: Column) -> Column:
    """A pipe table with padded cells; the empty string for a table without cells."""
    cell = lambda c: F.replace(squeeze(F.regexp_replace(c, "<[^>]+>", " ")), F.lit("|"), F.lit("\\|"))
    raw = F.transform(
        F.regexp_extract_all(html, F.lit(ROW), F.lit(1)),
        lambda r: F.struct(r.rlike("(?iu)<th").alias("head"), F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), cell).alias("cells")),
    )

    def drawn(rows: Column) -> Column:
        n = F.array_max(F.transform(rows, lambda r: F.size(r["cells"])))
        full = F.transform(rows, lambda r: F.concat(r["cells"], F.array_repeat(F.lit(""), n - F.size(r["cells"]))))
        head = F.coalesce(F.nullif(F.array_position(F.transform(rows, lambda r: r["head"]), True), F.lit(0)), F.lit(1)) - 1
        return let(F.struct(full.alias("full"), n.alias("n"), head.alias("head")), sized)

    def sized(t: Column) -> Column:
        widths = F.transform(F.sequence(F.lit(0), t["n"] - 1), lambda j: F.greatest(F.lit(3), F.array_max(F.transform(t["full"], lambda r: F.length(F.get(r, j))))))
        return let(widths, lambda w: lined(t, w))

    def lined(t: Column, w: Column) -> Column:
        bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        rule = bar(F.transform(w, lambda x: F.repeat(F.lit("-"), x)))
        row = lambda r: bar(F.zip_with(r, w, lambda c, x: F.rpad(c, x, F.lit(" "))))
        return F.array_join(F.flatten(F.transform(t["full"], lambda r, i: F.when(i == t["head"], F.array(row(r), rule)).otherwise(F.array(row(r))))), "\n")

    kept = F.filter(raw, lambda r: F.size(r["cells"]) > 0)
    return let(kept, lambda rows: F.when(F.size(rows) == 0, "").otherwise(drawn(rows)))


def convert_tables(content: Column) -> Column:
    """Every HTML table of a text as a pipe table; tables without cells stay."""

    def converted(t: Column) -> Column:
        for noise, instead in NOISE:
            t = F.regexp_replace(t, noise, instead)
        return t

    tables = F.transform(F.regexp_extract_all(content, F.lit(TABLE), F.lit(0)), lambda t: let(html_table_to_markdown(converted(t)), lambda m: F.when(m == "", t).otherwise(m)))
    return let(tables, lambda found: F.array_join(F.transform(F.split(content, TABLE, -1), lambda part, i: F.concat(part, F.coalesce(F.get(found, i), F.lit("")))), ""))


def reprocess(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with converted tables, whether a row changed, and how many tables it had (``found``)."""
    old = F.col(text)
    found = F.size(F.regexp_extract_all(F.coalesce(old, F.lit("")), F.lit(TABLE), F.lit(0)))
    return docs.withColumn("found", found).withColumn("updated", ~convert_tables(old).eqNullSafe(old)).withColumn(text, convert_tables(old))


def reprocess_counts(done: DataFrame) -> DataFrame:
    """One row: files, files changed, tables found."""
    return done.agg(F.count(F.lit(1)).alias("files"), F.count_if("updated").alias("changed"), F.coalesce(F.sum("found"), F.lit(0)).alias("tables"))


def analyze(files: DataFrame, analyzer: Callable[[bytes], str], key: str = "path") -> DataFrame:
    """Layout rows (``doc_id`` is the file's key) of files (key, content): ``analyzer`` is the layout service, bytes to its JSON.

    It is called in the executors, once for each file; a reply that is no JSON gives null fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: its bytes may be many
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0).cast(pa.string()), pa.array([analyzer(one.column(1)[0].as_py() or b"")], pa.string())], ["doc_id", "json"])

    fields = LAYOUT.replace("doc_id long, ", "")
    made = files.select(key, "content").mapInArrow(run, "doc_id string, json string")
    return made.select("doc_id", F.from_json("json", fields).alias("d")).select("doc_id", "d.*")
