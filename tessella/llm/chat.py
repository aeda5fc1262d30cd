"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn's cost is its token estimate plus a fixed overhead. The room of a window
is the budget less history and system turn; prefix sums of the costs are cut at
every seven eighths of the room, and the turns that start between two cuts make
a window. The last of them reaches over the cut: it goes with the others where
the room holds them all, else (or if it alone exceeds the room) it has a window
of its own. So spans are turn-aligned and nearly full, and which window a turn
is in follows from sums alone. Each window repeats the system turn (if the
conversation begins with one) and the turns within ``history`` tokens before its
first new turn; the loss mask covers assistant texts of new turns alone, so each
target counts once.

Template: ``<|role|>\\ntext</s>\\n`` per turn. Inside texts and roles a control
string gets a backslash after its first character (one more if it already has
some), which is undone by removing one: no text can forge a marker.

A conversation's order is (turn, role, text). Text is dealt out once, by
conversation; all windows and digests are made where it then lies. Conversations
whose turn numbers reach over a multiple of ``SEGMENT`` are dealt by segments
between such multiples, so that a huge one is many tasks: windows do not cross
segments, prefix sums begin anew in each, and copies of the system turn and of
the turns numbered last before a segment go with it as its context.

Defined cases: null text and null role are empty; null turn comes first;
repeated rows are turns of their own; a null conv_id is a conversation; turns of
one number are one task's; a turn of any length is in one window; other columns
play no part and may have any name; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed

END = "</s>\n"
SEGMENT = 256
#: conversations of several segments that are broadcast; beyond, they are joined
FEW = 100_000
NO_TURN = -(1 << 62)
#: first character, backslashes (one of them added), what makes it a control string
_PARTS = ((r"<", r"\||/?s>"), (r"\[", r"/?INST\]"), (r"\|", r">"))
_ESCAPE = "|".join(rf"({first})(\\*)(?={rest})" for first, rest in _PARTS)
_UNESCAPE = "|".join(rf"({first})\\(\\*)(?={rest})" for first, rest in _PARTS)


def escape(text: Column) -> Column:
    """One backslash more after the first character of every control string."""
    return F.regexp_replace(text, _ESCAPE, r"$1$3$5\\$2$4$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$3$5$2$4$6")


def token_estimate(text: Column) -> Column:
    """Words and signs, a native stand-in for a tokenizer's count."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


CONV = ["cz", "cn"]


def _rows(conversations: DataFrame, overhead: int, tokens) -> DataFrame:
    """cz, cn (a conversation, without nulls), turn, segment, role, text, cost."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    segment = F.floor(F.coalesce("turn", F.lit(NO_TURN)) / SEGMENT)
    return rows.select(F.coalesce("conv_id", F.lit(0)).alias("cz"), F.col("conv_id").isNull().alias("cn"), "turn", segment.alias("segment"), "role", "text", (tokens(F.col("text")) + overhead).alias("cost"))


def _with_copies(rows: DataFrame, reach: int) -> DataFrame:
    """Rows of kind 0, with those that later segments need: kind 1 for history, 2 for the system turn, 3 where there is none."""
    parts = rows.select(*CONV, "segment").distinct()
    least = rows.groupBy(*CONV).agg(F.min("segment").alias("lo"), F.min(F.struct(F.coalesce("turn", F.lit(NO_TURN)).alias("t"), "role", "text", "turn", "cost")).alias("s"))
    later = parts.join(least, CONV).where(F.col("segment") > F.col("lo"))
    leads = F.col("s.role") == "system"
    system = later.select(*CONV, F.col("s.turn").alias("turn"), "segment", F.when(leads, F.col("s.role")).alias("role"), F.when(leads, F.col("s.text")).alias("text"), F.when(leads, F.col("s.cost")).otherwise(0).alias("cost"), F.when(leads, 2).otherwise(3).alias("kind"))
    near = rows.where(F.pmod("turn", F.lit(SEGMENT)) >= SEGMENT - reach).withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(1))
    # the system turn is context already
    near = near.join(system.where("kind = 2").select(*CONV, "segment", F.col("turn").alias("t2"), F.col("role").alias("r2"), F.col("text").alias("x2")), [*CONV, "segment"], "left")
    near = near.where(~F.coalesce(F.col("turn").eqNullSafe(F.col("t2")) & (F.col("role") == F.col("r2")) & (F.col("text") == F.col("x2")), F.lit(False))).drop("t2", "r2", "x2")
    return rows.withColumn("kind", F.lit(0)).unionByName(near).unionByName(system)


def _windows(rows: DataFrame, keys: list[str], budget: int, history: int, system: int) -> DataFrame:
    """Windows of every group of ``keys``: context and fresh turns."""
    whole = W.partitionBy(*keys)
    order = whole.orderBy(F.desc("kind"), F.col("turn").asc_nulls_first(), "role", "text")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    counted = F.when(F.col("kind") <= 1, F.col("cost")).otherwise(0)
    t = rows.withColumn("upto", F.sum(counted).over(running)).withColumn("n", F.row_number().over(order))
    t = t.withColumn("first", F.first(F.struct("kind", (F.col("role") == "system").alias("leads"), "cost")).over(running))
    t = t.withColumn("start", F.col("upto") - F.col("cost") - F.sum(F.when(F.col("kind") == 1, F.col("cost")).otherwise(0)).over(whole))
    has = (F.col("first.kind") == 2) | ((F.col("first.kind") == 0) & F.col("first.leads"))
    t = t.withColumn("has", has).withColumn("sys", has & (F.col("n") == 1))
    t = t.withColumn("room", F.lit(budget - history) - F.when(F.col("has"), F.least(F.col("first.cost"), F.lit(system))).otherwise(0))
    t = t.withColumn("unit", F.expr("room * 7 div 8")).withColumn("end", F.col("start") + F.col("cost"))
    t = t.withColumn("cell", F.when(F.col("kind") <= 1, F.floor(F.col("start") / F.col("unit"))))
    cell = W.partitionBy(*keys, "cell")
    over = F.floor((F.col("end") - 1) / F.col("unit")) > F.col("cell")
    t = t.withColumn("alone", over & (F.col("end") - F.min("start").over(cell) > F.col("room")))
    last, lone = F.max("end").over(cell), F.max(F.when(F.col("alone"), F.col("start"))).over(cell)
    t = t.withColumn("last", last).withColumn("lone", lone)
    own = F.when(F.col("kind") == 0, 2 * F.col("cell") + F.when(F.col("alone"), 2).otherwise(1)).when(F.col("kind") == 2, -1)
    # histories of the windows that may begin within ``history`` tokens after the turn
    repeats = (F.col("kind") <= 1) & ~F.col("sys")
    ahead = lambda k, when: F.when(repeats & when, 2 * F.col("cell") + k)
    soon = F.col("start") >= F.col("last") - history
    in_cell = (F.col("start") < F.col("lone")) & (F.col("start") >= F.col("lone") - history)
    role, text = escape(F.col("role")), escape(F.col("text"))
    t = t.withColumn("role_", role).withColumn("text_", text)
    turn = F.struct(
        "start",
        "cost",
        (F.col("role") == "assistant").alias("said"),
        (F.length("role_") + 5).alias("lead"),
        F.length("text_").alias("size"),
        F.concat(F.lit("<|"), "role_", F.lit("|>\n"), "text_", F.lit(END)).alias("r"),
    )
    t = t.select(*keys, "has", own.alias("own"), turn.alias("t"), F.explode(F.array_compact(F.array(own, ahead(2, in_cell), ahead(3, soon), ahead(4, soon)))).alias("window"))
    new = F.col("window") == F.col("own")
    held = t.groupBy(*keys, "window").agg(
        F.max("has").alias("has"),
        F.array_sort(F.collect_list(F.when(F.coalesce(new, F.lit(False)), F.col("t")))).alias("fresh"),
        F.array_sort(F.collect_list(F.when(~F.coalesce(new, F.lit(False)), F.col("t")))).alias("past"),
    )
    held = held.where(F.size("fresh") > 0)
    lead = F.first(F.when(F.col("has"), F.col("fresh")[0])).over(W.partitionBy(*keys).orderBy("window").rowsBetween(W.unboundedPreceding, 0))
    held = held.withColumn("lead", lead).withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy("window")))
    first = F.col("fresh")[0]
    past = F.filter("past", lambda x: x["start"] >= first["start"] - history)
    ahead_ = F.when(F.col("has") & (F.col("at") > 1), F.concat(F.array("lead"), past)).otherwise(past)
    return held.where("window >= 0").withColumn("context", ahead_)


def _targets(turns: Column, base: Column) -> Column:
    """(start, length) in code points of each assistant text, where ``turns`` are rendered from ``base`` on."""

    def step(acc, t):
        span = F.struct((acc["at"] + t["lead"]).cast("int").alias("start"), t["size"].cast("int").alias("length"))
        found = F.when(t["said"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((acc["at"] + t["lead"] + t["size"] + F.lit(len(END))).cast("int").alias("at"), found.alias("found"))

    zero = F.struct(base.cast("int").alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>").alias("found"))
    return F.aggregate(turns, zero, step, lambda acc: acc["found"])


def _rendered(held: DataFrame, keys: list[str]) -> DataFrame:
    joined = lambda name: F.array_join(F.transform(name, lambda t: t["r"]), "")
    held = held.withColumn("ahead", joined("context"))
    return held.select(
        *keys,
        "window",
        F.size("context").cast("long").alias("n_context"),
        F.size("fresh").cast("long").alias("n_new"),
        F.aggregate(F.concat("context", "fresh"), F.lit(0).cast("long"), lambda a, t: a + t["cost"]).alias("n_tokens"),
        F.concat("ahead", joined("fresh")).alias("formatted"),
        _targets(F.col("fresh"), F.length("ahead")).alias("loss"),
    )


def _formatted(conversations: DataFrame, budget: int, history: int, system: int, overhead: int, tokens) -> list[tuple[DataFrame, list[str]]]:
    """Windows of the conversations of one segment, and of the others, each with the columns that they are dealt by."""
    if overhead < 1 or not 0 <= history <= (budget - history - system) * 7 // 8:
        raise ValueError("overhead must be at least 1, history at most seven eighths of what the budget leaves")
    rows = _rows(conversations, overhead, tokens)
    spans = rows.groupBy(*CONV).agg(F.min("segment").alias("lo"), F.max("segment").alias("hi"))
    long = checkpointed(spans.where("lo < hi").select(*CONV))
    n = long.count()
    made = lambda part, keys: (_rendered(_windows(part, keys, budget, history, system), keys), keys)
    if not n:
        return [made(rows.withColumn("kind", F.lit(0)), CONV)]
    long = F.broadcast(long) if n <= FEW else long
    one, several = rows.join(long, CONV, "left_anti"), rows.join(long, CONV, "left_semi")
    return [made(one.withColumn("kind", F.lit(0)), CONV), made(_with_copies(several, min(SEGMENT, history // overhead)), [*CONV, "segment"])]


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 128, system: int = 128, overhead: int = 4, tokens=token_estimate) -> DataFrame:
    """conv_id, segment, window, n_context, n_new, n_tokens, formatted, loss array<struct<start,length>>.

    A conversation's windows are in order of (segment, window). ``n_context``:
    turns at the beginning that are repeated (system turn and history).
    ``n_tokens``: cost of all turns in the window, at most ``budget`` unless the
    system turn exceeds ``system`` or one turn the room that is left.
    """
    out = None
    for windows, keys in _formatted(conversations, budget, history, system, overhead, tokens):
        part = windows.select(F.when(~F.col("cn"), F.col("cz")).alias("conv_id"), (F.col("segment") if "segment" in keys else F.lit(None).cast("long")).alias("segment"), "window", "n_context", "n_new", "n_tokens", "formatted", "loss")
        out = part if out is None else out.unionByName(part)
    return out


def read_turns(windows: DataFrame) -> DataFrame:
    """Adds ``turns`` array<struct<role,text>>, parsed from ``formatted``."""
    chunks = F.split("formatted", END, -1)
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)
    role = lambda c: F.substring_index(c, "|>\n", 1)
    return windows.withColumn(
        "turns",
        F.transform(chunks, lambda c: F.struct(unescape(F.substr(role(c), F.lit(3))).alias("role"), unescape(F.substr(c, F.length(role(c)) + 4)).alias("text"))),
    )


def loss_text(windows: DataFrame) -> DataFrame:
    """Adds ``targets``: the text under the mask, unescaped."""
    spans = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.withColumn("targets", F.array_join(spans, ""))


def digests(conversations: DataFrame, budget: int = 1024, history: int = 128, system: int = 128, overhead: int = 4, tokens=token_estimate) -> DataFrame:
    """One row per conversation, read back from its windows.

    The hash of a whole conversation needs its text in one row. Conversations of
    one segment are joined where they lie; only others are dealt out once more.
    """
    out = None
    for windows, keys in _formatted(conversations, budget, history, system, overhead, tokens):
        read = loss_text(read_turns(windows))
        fresh = F.slice("turns", F.col("n_context").cast("int") + 1, F.greatest(F.size("turns") - F.col("n_context").cast("int"), F.lit(0)))
        read = read.select(
            *CONV,
            "n_new",
            F.length("formatted").cast("long").alias("chars"),
            F.struct(
                *(k for k in keys if k not in CONV),
                "window",
                F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
                "targets",
            ).alias("piece"),
        )
        one = read.groupBy(*CONV).agg(F.sum("n_new").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.array_sort(F.collect_list("piece")).alias("pieces"))
        joined = lambda name: F.array_join(F.transform("pieces", lambda p: p[name]), "")
        one = one.withColumn("all_turns", joined("turns")).withColumn("all_targets", joined("targets"))
        one = one.select(
            F.when(~F.col("cn"), F.col("cz")).alias("conv_id"),
            "n_turns",
            F.sha2(F.col("all_turns").cast("binary"), 256).alias("turns_sha256"),
            F.length("all_targets").cast("long").alias("loss_chars"),
            F.sha2(F.col("all_targets").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
            "n_windows",
        )
        out = one if out is None else out.unionByName(one)
    return out
