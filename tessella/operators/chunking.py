"""Markdown to chunks: line states, packing into windows, chunk columns.

A document's lines are read once in order and a section's blocks are packed
greedily, which no relational operator expresses; both are done document by
document in Arrow batches. Everything that depends on one chunk alone (ids,
types, flags, metadata) is a column expression afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

#: documents whose chunks are Python objects at once
STEP = 500
# Chunks are only right with exactly these sizes, labels and patterns.
MAX_CHARS = 2400
OVERLAP = 320
SEPARATORS = ("\n\n", ". ", "\n")
PROCESS_KEYS = (
    "PROCESS NUMBER",
    "PROCESS NAME",
    "PROCESS DEFINITION",
    "TRIGGER(S)",
    "PROCESS RULES",
    "PROCESS INPUTS",
    "PROCESS OUTPUTS",
    "SUB OR PRECEDING PROCESSES",
    "COMMENTS",
    "COMMENT",
)
FIGURE_LABELS = ("[Figure Caption]", "[Figure Description]", "[Figure Content]")
_SYMBOLS = re.compile("[☒✓□]")
_ANY_CASE_ALL = re.IGNORECASE | re.DOTALL
_ROW = re.compile("<tr[^>]*>(.*?)</tr>", _ANY_CASE_ALL)
_CELL = re.compile("<t[dh][^>]*>(.*?)</t[dh]>", _ANY_CASE_ALL)
_TAG = re.compile("<[^>]+>")
_BLANKS = re.compile(r"\s+")
_COMMENT = re.compile("<!--.*?-->", re.DOTALL)
_DESCRIBED = re.compile(r"<!--\s*AI Description:(.*?)-->", re.DOTALL)
_CAPTION = re.compile("<figcaption>(.*?)</figcaption>", _ANY_CASE_ALL)
_PAGE = re.compile(r'PageNumber["\s=]+(\d+)')
_FOOTER = re.compile(r'Submitted:\s*([^"]+)')
_HEADING = re.compile(r"(#{1,5})\s+(.*)")
_RULE = re.compile(r"-{3,}$")


def split_overlap(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters that share ``overlap`` with the one before.

    A short text is its own piece, unstripped. The step back from an end that
    lies beyond the text may yield a last piece that is contained in the one
    before it; that is part of the definition.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    out, at = [], 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            cuts = ((text.rfind(s, at, stop), s) for s in SEPARATORS)
            stop = next((p + len(s) for p, s in cuts if p > at + overlap), stop)
        if piece := text[at:stop].strip():
            out.append(piece)
        at = stop - overlap
    return out


def pack(pieces: list[tuple[str, bool]], size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Windows over (text, atomic) pieces, each joined by blank lines.

    An atomic piece is never cut: it closes the window before it if both exceed
    ``size``, and after it if the window is full. Text that does not fit closes
    the window and takes along the last ``overlap`` characters of it.
    """
    done: list[list[str]] = []
    window: list[str] = []
    used = 0
    for text, atomic in pieces:
        if used + len(text) <= size or (atomic and not window):
            window.append(text)
            used += len(text)
        elif atomic:
            done.append(window)
            window, used = [text], len(text)
        else:
            tail = ""
            if window:
                tail = "\n\n".join(window)[-overlap:].strip()
                done.append(window)
            whole = f"{tail}\n\n{text}".strip() if tail else text
            parts = split_overlap(whole, size, overlap) if len(whole) > size else [whole]
            done += [[p] for p in parts[:-1]]
            window, used = ([parts[-1]], len(parts[-1])) if parts else ([], 0)
        if atomic and used >= size:
            done.append(window)
            window, used = [], 0
    if window:
        done.append(window)
    return [t for w in done if (t := "\n\n".join(w).strip())]


def table_rows(html: str) -> list[list[str]]:
    """Cells of a table's rows, tags dropped; rows without any text are left out."""
    rows = ([_BLANKS.sub(" ", _TAG.sub("", c)).strip() for c in _CELL.findall(r)] for r in _ROW.findall(html))
    return [r for r in rows if any(r)]


def is_process(rows: list[list[str]]) -> bool:
    return any(r[0].upper().rstrip(":") in PROCESS_KEYS for r in rows if r)


def process_text(rows: list[list[str]]) -> str:
    """``KEY: value`` lines, known keys first; a lone cell continues the key entered last."""
    values: dict[str, str] = {}
    for first, *rest in rows:
        if rest:
            key, value = first.rstrip(":").strip(), " ".join(rest).strip()
            if key and value:
                values[key] = value
        elif first and values:
            values[next(reversed(values))] += f" {first}"
    known = [k for k in PROCESS_KEYS if k in values]
    return "\n".join(f"{k}: {values[k]}" for k in known + [k for k in values if k not in PROCESS_KEYS])


def table_text(html: str) -> str:
    rows = table_rows(html)
    return process_text(rows) if is_process(rows) else "\n".join(map(" | ".join, rows))


def figure_text(html: str) -> str:
    """Caption, description, and the text inside where it is longer than 20 characters."""

    def only(pattern: re.Pattern) -> str:
        m = pattern.search(html)
        return _BLANKS.sub(" ", m[1]).strip() if m else ""

    inside = html
    for drop in (_COMMENT, _TAG, _SYMBOLS):
        inside = drop.sub("", inside)
    inside = _BLANKS.sub(" ", inside).strip()
    parts = (only(_CAPTION), only(_DESCRIBED), inside if len(inside) > 20 else "")
    return "\n".join(f"{k} {v}" for k, v in zip(FIGURE_LABELS, parts) if v)


@dataclass
class Section:
    headings: list[str]
    page_start: int | None
    page_end: int | None
    blocks: list[tuple[str, str]]
    submitted: str | None  # from a page footer seen before the section ended


@dataclass
class _Reader:
    """The state between two lines of a document."""

    headings: list[str] = field(default_factory=list)
    page: int | None = None
    section_page: int | None = None
    submitted: str | None = None
    blocks: list[tuple[str, str]] = field(default_factory=list)
    figure: list[str] | None = None
    table: list[str] | None = None
    pipes: list[str] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)

    def add(self, kind: str, text: str) -> None:
        if text.strip():
            self.blocks.append((kind, text))

    def close_pipes(self) -> None:
        if self.pipes:
            self.add("table", "\n".join(x.rstrip() for x in self.pipes).strip())
            self.pipes = []

    def close_section(self) -> None:
        if self.blocks:
            self.sections.append(Section(list(self.headings), self.section_page, self.page, self.blocks, self.submitted))
        self.blocks, self.section_page = [], self.page

    def comment(self, line: str, bare: str) -> None:
        if "PageHeader" in bare:
            return
        if "PageFooter" in bare:
            m = _FOOTER.search(bare)
            if m and self.submitted is None:
                self.submitted = m[1].strip()
        elif self.figure is not None:
            self.figure.append(line)

    def line(self, line: str) -> None:
        bare = line.strip()
        if not bare or bare == "<!-- PageBreak -->":
            return  # blank lines join no paragraphs: every line is one
        if "PageNumber" in bare:
            if m := _PAGE.search(bare):
                self.page = int(m[1])
                self.section_page = self.page if self.section_page is None else self.section_page
            return
        if bare.startswith("<!--"):
            return self.comment(line, bare)
        low = bare.lower()
        if low.startswith("<figure"):
            self.figure = [line]
        elif self.figure is not None:
            self.figure.append(line)
            if low.startswith("</figure"):
                self.add("figure", figure_text("".join(self.figure)))
                self.figure = None
        elif low.startswith("<table"):
            self.table = [line]
        elif self.table is not None:
            self.table.append(line)
            if low.startswith("</table"):
                self.add("table", table_text("".join(self.table)))
                self.table = None
        elif bare.startswith("|"):
            self.pipes.append(line)
        else:
            self.close_pipes()
            if m := _HEADING.match(bare):
                self.close_section()
                self.headings = [*self.headings[: len(m[1]) - 1], m[2].strip()]
            elif not _RULE.match(bare):
                self.add("text", bare)


def read_sections(text: str) -> list[Section]:
    """Sections with their blocks, in order. What an unclosed figure or HTML table holds is lost."""
    reader = _Reader()
    for line in text.splitlines(keepends=True):
        reader.line(line)
    reader.close_pipes()
    reader.close_section()
    return reader.sections


def merged(blocks: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """(text, atomic): consecutive text blocks become one piece of paragraphs."""
    out: list[tuple[str, bool]] = []
    for kind, text in blocks:
        if kind == "text" and out and not out[-1][1]:
            out[-1] = (f"{out[-1][0]}\n\n{text.strip()}", False)
        else:
            out.append((text.strip(), kind != "text"))
    return out


BLOCKS = "section_no int, block_no int, headings array<string>, page_start int, page_end int, kind string, text string"
WINDOWS = "chunk_index int, headings array<string>, page_start int, page_end int, footer_submitted string, content string"


def _flat(docs: DataFrame, key: list[str], text: str, schema: str, rows) -> DataFrame:
    """Rows that ``rows(text)`` gives for each document, beside its key columns."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, STEP) for b in batches for k in range(0, b.num_rows, STEP)):  # few documents' objects at a time
            at, cols = [], [[] for _ in names]
            for k, t in enumerate(batch.column(text).to_pylist()):
                for row in rows(t or ""):
                    at.append(k)
                    for c, v in zip(cols, row):
                        c.append(v)
            types = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
            made = [pa.array(c, types[p.split(" ", 1)[1]]) for c, p in zip(cols, schema.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at, pa.int64())) for c in key] + made, [*key, *names])

    return docs.select(*key, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", " + schema)


def markdown_blocks(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per block: text lines, rendered tables and figures."""

    def rows(t: str):
        for n, s in enumerate(read_sections(t)):
            for k, (kind, content) in enumerate(s.blocks):
                yield n, k, s.headings, s.page_start, s.page_end, kind, content

    return _flat(docs, key, text, BLOCKS, rows)


def split_documents(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per piece of ``split_overlap``."""
    return _flat(docs, key, text, "piece_no int, content string", lambda t: enumerate(split_overlap(t)))


def breadcrumb(headings: Column) -> dict[str, Column]:
    at = lambda k: F.coalesce(F.try_element_at(headings, F.lit(k)), F.lit(""))
    return {
        "heading_level": F.size(headings),
        "topic": at(1),
        "subtopic": at(2),
        "section_title": at(-1),
        "section": F.when(F.size(headings) == 0, "Document").otherwise(F.array_join(headings, " > ")),
    }


def heading_stack(headings: Column) -> Column:
    """The stack after a series of struct<lvl, txt>: cut to lvl - 1 entries, then pushed."""
    return F.aggregate(headings, F.array().cast("array<string>"), lambda a, h: F.concat(F.slice(a, 1, h["lvl"] - 1), F.array(h["txt"])))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(source, utility, text) to chunks: one row per window with the chunk columns."""

    def rows(t: str):
        n = 0
        for s in read_sections(t):
            for content in pack(merged(s.blocks)):
                yield n, s.headings, s.page_start, s.page_end, s.submitted, content
                n += 1

    meta = docs.select("source", "utility", "text", *[c.alias(f"m_{k}") for k, c in T.doc_metadata(F.col("text")).items()])
    made = _flat(meta, ["source", "utility", *[f"m_{k}" for k in T.doc_metadata(F.col("text"))]], "text", WINDOWS, rows)
    content = F.col("content")
    metadata = F.struct(
        *[F.col(f"m_{k}").alias(k) for k in ("source_pdf_name", "source_pdf_url", "total_pages", "total_tables", "doc_version", "case_number")],
        F.coalesce("m_submitted", "footer_submitted").alias("submitted"),
        F.length(content).alias("char_count"),
        T.token_estimate(content).alias("token_estimate"),
    )
    return made.select(
        T.chunk_id(F.col("source"), F.col("chunk_index"), content).alias("chunk_id"),
        "source",
        "chunk_index",
        "page_start",
        "page_end",
        *[c.alias(k) for k, c in breadcrumb(F.col("headings")).items()],
        F.coalesce("m_source_pdf_url", F.lit("")).alias("source_pdf_url"),
        F.coalesce("m_source_pdf_name", F.lit("")).alias("source_pdf_name"),
        F.lit(T.REGION).alias("region"),
        F.col("utility").alias("energy_utility_name"),
        "content",
        T.content_type(content).alias("content_type"),
        T.has_table(content).alias("has_table"),
        T.has_figure(content).alias("has_figure"),
        F.lit(False).alias("is_table"),
        F.lit(False).alias("is_figure"),
        T.has_table(content).cast("int").alias("table_count"),
        T.has_figure(content).cast("int").alias("figure_count"),
        metadata.alias("metadata"),
    )
