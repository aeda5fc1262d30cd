"""Question and answer records: flattening, feedback, frequent questions.

``rows`` are (session_id, msg_id, question, answer, feedback, created_at), all
strings; ``records`` are (session_id, messages array<MESSAGE>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<msgId:string,question:string,answer:string,feedback:string,created_at:string>"
ROW = ("session_id", "msg_id", "question", "answer", "feedback", "created_at")


def spaced_json(text: Column) -> Column:
    """Compact JSON with a blank after every comma and colon outside strings."""
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")


def flatten(blobs: DataFrame, now: str, raw: str = "raw") -> DataFrame:
    """JSON records to rows. Text that is no JSON object gives none; ``now`` stands in for a missing time."""
    parsed = blobs.where(F.try_parse_json(raw).isNotNull()).select(F.from_json(raw, "session_id string, messages array<string>").alias("d"))
    each = parsed.select(F.coalesce("d.session_id", F.lit("")).alias("session_id"), F.explode("d.messages").alias("m"))
    each = each.select("session_id", "m", F.from_json("m", "map<string,string>").alias("f"))
    field = lambda name: F.when(F.map_contains_key("f", name), F.col("f")[name]).otherwise("")
    given = F.col("f")["feedback"]
    text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("m"), "$.feedback", "variant")) == "STRING"
    return each.select(
        "session_id",
        field("msgId").alias("msg_id"),
        field("question").alias("question"),
        field("answer").alias("answer"),
        F.when(text, given).otherwise(spaced_json(given)).alias("feedback"),
        F.coalesce(F.nullif(F.col("f")["created_at"], F.lit("")), F.nullif(F.col("f")["createdAt"], F.lit("")), F.lit(now)).alias("created_at"),
    )


def faq(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The questions asked most, each with its latest answer; ties by later text, then question.

    One hash aggregation instead of two windows over all rows.
    """
    asked = rows.where("question <> '' and answer <> ''")
    latest = F.max_by("answer", F.struct(F.try_to_timestamp(F.col("created_at").cast("string")), "answer"))
    return asked.groupBy("question").agg(latest.alias("answer"), F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "question").limit(limit)


def latest_rows(rows: DataFrame) -> DataFrame:
    """One row for each (session_id, msg_id): the last, rows with a question before those without."""
    best = F.max_by(F.struct(*ROW), F.struct(F.col("question") != "", "created_at", "question", "answer", "feedback"))
    return rows.groupBy(F.col("session_id").alias("s"), F.col("msg_id").alias("m")).agg(best.alias("r")).select("r.*")


def upsert_feedback(rows: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """``updates`` (session_id, msg_id, feedback, seq): the last of a key changes all its rows, or adds one."""
    last = updates.groupBy(F.col("session_id").alias("s"), F.col("msg_id").alias("m")).agg(F.max_by("feedback", "seq").alias("new"), F.lit(True).alias("given"))
    both = rows.join(last, (F.col("session_id") == F.col("s")) & (F.col("msg_id") == F.col("m")), "full_outer")
    added = F.col("session_id").isNull() & F.col("s").isNotNull()
    fresh = {"session_id": F.col("s"), "msg_id": F.col("m"), "question": F.lit(""), "answer": F.lit(""), "created_at": F.lit(now)}
    out = {c: F.when(added, v).otherwise(F.col(c)) for c, v in fresh.items()} | {"feedback": F.when(F.col("given"), F.col("new")).otherwise(F.col("feedback"))}
    return both.select(*[out[c].alias(c) for c in ROW])


def has_message(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys (session_id, msg_id) that have a row."""
    return keys.join(rows, ["session_id", "msg_id"], "left_semi")


def message(msg_id, question, answer, feedback, created_at) -> Column:
    names = ("msgId", "question", "answer", "feedback", "created_at")
    return F.struct(*[F.lit(v).cast("string").alias(n) if not isinstance(v, Column) else v.cast("string").alias(n) for n, v in zip(names, (msg_id, question, answer, feedback, created_at))])


def append_message(messages: Column, msg_id, question, answer, now) -> Column:
    return F.concat(messages, F.array(message(msg_id, question, answer, None, now)))


def attach_feedback(messages: Column, serial: Column, feedback: Column, now, new_id: Column | None = None) -> Column:
    """Feedback on the first message with the serial, else on a new one (``new_id`` where the serial is blank)."""
    key = F.coalesce(serial, F.lit(""))
    at = F.array_position(F.transform(messages, lambda m: m["msgId"]), key)
    put = F.transform(messages, lambda m, i: F.when(i + 1 == at, m.withField("feedback", feedback)).otherwise(m))
    fresh = F.when(key == "", new_id if new_id is not None else F.uuid()).otherwise(key)
    return F.when(at > 0, put).otherwise(F.concat(messages, F.array(message(fresh, "", "", feedback, now))))


def hoist_created(messages: Column, created: Column) -> Column:
    """The session's time on its first message, if that has none."""
    needs = (F.coalesce(created, F.lit("")) != "") & (F.size(messages) > 0)
    first = F.transform(messages, lambda m, i: F.when((i == 0) & (F.coalesce(m["created_at"], F.lit("")) == ""), m.withField("created_at", created)).otherwise(m))
    return F.when(needs, first).otherwise(messages)


def load_records(wanted: DataFrame, *stores: DataFrame) -> DataFrame:
    """session_id and messages from the first store (session_id, created_at, messages) that has the session, else none."""
    out = wanted.select("session_id")
    names = []
    for k, s in enumerate(stores):
        names.append(f"r{k}")
        out = out.join(s.select("session_id", F.struct(hoist_created(F.col("messages"), F.col("created_at")).alias("messages")).alias(names[-1])), "session_id", "left")
    found = F.coalesce(*[F.col(f"{n}.messages") for n in names], F.from_json(F.lit("[]"), f"array<{MESSAGE}>"))
    return out.select("session_id", found.alias("messages"))


def repair_sessions(raw: Column) -> Column:
    """Sessions as an array of JSON texts, from a file that may be cut or have noise around its list."""
    cut = F.regexp_extract(raw, r"(?s)\A(.*\])?", 0)
    cut = F.when(cut == "", raw).otherwise(cut)
    found = F.regexp_extract(cut, r"(?s)\[.*\]", 0)
    text = F.when(found == "", F.trim(cut)).otherwise(found)
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, "array<string>")), none)


def put_sessions(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, position, payload): the last update of an id takes its place, new ids go to the end."""
    last = updates.groupBy(F.col("id").alias("u")).agg(F.max_by("payload", "seq").alias("new"), F.min("seq").alias("seq"))
    end = sessions.agg(F.coalesce(F.max("position") + 1, F.lit(0)).cast("long").alias("end"))
    both = sessions.join(last, F.col("id") == F.col("u"), "full_outer").join(F.broadcast(end))  # one row
    place = F.coalesce(F.col("position"), F.col("end") + F.col("seq"))
    return both.select(F.coalesce("id", "u").alias("id"), place.alias("position"), F.coalesce("new", "payload").alias("payload"))


def session(sessions: DataFrame, session_id: str) -> DataFrame:
    """The first session with the id; no row without one."""
    return sessions.where(F.col("id") == session_id).orderBy("position").limit(1)

