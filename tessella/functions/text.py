"""Column expressions for text: whitespace, chunk attributes, document metadata.

Whitespace is the 29-character Unicode set, not Java's; patterns carry ``(?d)``
so that only a newline ends a line, and ``(?iu)`` where case is ignored. In
metadata patterns and list marks ``\\d`` and ``\\s`` are ASCII: digits of other
scripts are no page count, version or list number here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
# Chunk columns and filters are only right with exactly these.
CHARS_PER_TOKEN = 4
REGION = "New York"
FIGURE_MARKS = ("[Figure", "[Flowchart", "[Process Steps]")
FILTER_PLACEHOLDERS = ("", "string", "unknown", "placeholder", "none", "null")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends."""
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def lines(c: Column) -> Column:
    """Lines without their ends; no empty line after a final line end."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def last_index(c: Column, sep: str) -> Column:
    """0-based place of the last ``sep``, -1 if there is none."""
    at = F.locate(sep[::-1], F.reverse(c))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at - len(sep) + 1)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int")


def _has_any(c: Column, marks: tuple[str, ...]) -> Column:
    found = F.contains(c, F.lit(marks[0]))
    for m in marks[1:]:
        found = found | F.contains(c, F.lit(m))
    return found


def content_type(c: Column) -> Column:
    """mixed, table, figure, list or text."""
    table, figure = F.contains(c, F.lit("|")), _has_any(c, FIGURE_MARKS)
    listed = c.rlike(rf"(?md)^{SPACE}*(\d+\.|[-•*]){SPACE}")
    return F.when(table & figure, "mixed").when(table, "table").when(figure, "figure").when(listed, "list").otherwise("text")


def has_table(c: Column) -> Column:
    """A pipe, or a line that begins with a capitalised label (rendered process tables)."""
    return F.contains(c, F.lit("|")) | c.rlike(rf"(?md)^[A-Z ]{{4,}}:{SPACE}")


def has_figure(c: Column) -> Column:
    return _has_any(c, ("[Figure Caption]", "[Figure Description]", "[Figure Content]"))


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+\z", "")


# Fixed values, down to session_file: signs that ids and names keep, lengths and patterns of ids and metadata.
def chunk_id(source: Column, index: Column, content: Column) -> Column:
    """Stem, four-digit index and twelve hex digits of source, index and the first 80 characters."""
    digest = F.substring(F.md5(F.concat(source, F.lit(":"), index.cast("string"), F.lit(":"), F.substring(content, 1, 80)).cast("binary")), 1, 12)
    safe = F.regexp_replace(F.regexp_replace(stem(source), r"[^A-Za-z0-9_\-=]+", "_"), r"\A_+|_+\z", "")
    number = F.when(F.length(index.cast("string")) < 4, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))
    return F.concat_ws("_", safe, number, digest)


def safe_name(name: Column) -> Column:
    """Every unsafe character as an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_\-]", "_"), r"\A_+|_+\z", "")


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


# Where a document names its source.
LINK = r"(?iud)Source PDF[^\[\n]*\[([^\]]+)\]\(([^)\n]+)\)"
PLAIN = r"(?iud)Source PDF[^h\n]*(https?://[^\s)\n]+)"


def doc_metadata(text: Column) -> dict[str, Column]:
    """Metadata found in a document: the head's first 3000 characters, the first 8000, or all of it."""
    head, body = F.substring(text, 1, 3000), F.substring(text, 1, 8000)
    linked = head.rlike(LINK)
    url = strip(_found(head, PLAIN))
    path = F.substring_index(url, "?", 1)
    submitted = r'(?iud)Submitted:\s*([^\n"*]+)'
    return {
        "source_pdf_name": F.when(linked, strip(F.regexp_extract(head, LINK, 1))).otherwise(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)),
        "source_pdf_url": F.when(linked, strip(F.regexp_extract(head, LINK, 2))).otherwise(url),
        "total_pages": _found(head, r"(?iud)Total Pages[^0-9\n]*(\d+)").cast("int"),
        "total_tables": _found(head, r"(?iud)Total Tables[^0-9\n]*(\d+)").cast("int"),
        "doc_version": _found(body, r"(?iud)VERSION\s+([\d.]+)"),
        "case_number": _found(body, r"(?iud)Case\s+([\d-]+[A-Z]-[\d]+)"),
        "submitted": strip(_found(text, submitted)),
    }


def normalize_filter(c: Column) -> Column:
    """A trimmed filter value; null where it is a placeholder."""
    value = strip(c)
    return F.when(~F.lower(value).isin(*FILTER_PLACEHOLDERS), value)


def session_file(c: Column) -> Column:
    return F.concat(F.regexp_replace(c, r"(?U)[^\w\-]", "_"), F.lit(".json"))
