import json

from pyspark.sql import functions as F

from tessella.operators import sessions as S

ROWS = "session_id string, msg_id string, question string, answer string, feedback string, created_at string"
NOW = "2026-01-01T00:00:00+00:00"


def test_faq(spark):
    rows = [("s", "1", "q1", "a1", None, "2024-01-01"), ("s", "2", "q1", "a2", None, "2024-01-03"), ("s", "3", "q2", "b1", None, "2024-01-02"), ("s", "4", "", "x", None, "2024-01-04"), ("s", "5", "q3", None, None, "2024-01-05")]
    got = S.faq(spark.createDataFrame(rows, ROWS)).collect()
    assert [(r.question, r.answer) for r in got] == [("q1", "a2"), ("q2", "b1")]
    assert S.faq(spark.createDataFrame(rows, ROWS), 1).count() == 1


def test_flatten(spark):
    good = {"session_id": "s", "messages": [
        {"msgId": "1", "question": "q", "answer": None, "feedback": {"r": 1, "t": "a,b:c", "n": [1, 2]}, "created_at": "", "createdAt": "2024"},
        {"question": "é", "feedback": "ok", "created_at": "2025"},
        {"msgId": "3", "feedback": None},
        {"msgId": "4", "feedback": True},
    ]}
    blobs = [(json.dumps(good, ensure_ascii=False),), ("{broken",), ("",), (None,), ('{"session_id":"e","messages":[]}',)]
    got = sorted(map(tuple, S.flatten(spark.createDataFrame(blobs, "raw string"), NOW).collect()))
    want = [("s", "", "é", "", "ok", "2025"), ("s", "1", "q", None, '{"r": 1, "t": "a,b:c", "n": [1, 2]}', "2024"), ("s", "3", "", "", None, NOW), ("s", "4", "", "", "true", NOW)]
    assert got == want


def test_upsert_feedback(spark):
    rows = [("s", "m", "q", "a", None, "t"), ("s", "m", "q2", "a2", "old", "t"), ("s", "n", "q", "a", "keep", "t")]
    updates = [("s", "m", "first", 1), ("s", "m", "last", 2), ("x", "y", "new", 3)]
    got = S.upsert_feedback(spark.createDataFrame(rows, ROWS), spark.createDataFrame(updates, "session_id string, msg_id string, feedback string, seq int"), NOW)
    assert sorted(map(tuple, got.collect())) == [("s", "m", "q", "a", "last", "t"), ("s", "m", "q2", "a2", "last", "t"), ("s", "n", "q", "a", "keep", "t"), ("x", "y", "", "", "new", NOW)]
    keys = spark.createDataFrame([("s", "m"), ("z", "m")], "session_id string, msg_id string")
    assert [tuple(r) for r in S.has_message(spark.createDataFrame(rows, ROWS), keys).collect()] == [("s", "m")]


def test_messages(spark):
    one = spark.range(1).select(F.array(S.message("1", "q", "a", None, None), S.message("1", "q2", "a2", None, "t"), S.message("", "q3", "", None, "t")).alias("m"))
    got = one.select(S.attach_feedback(F.col("m"), F.lit("1"), F.lit("up"), NOW).alias("m")).first().m
    assert [x.feedback for x in got] == ["up", None, None]
    got = one.select(S.attach_feedback(F.col("m"), F.lit("9"), F.lit("up"), NOW).alias("m")).first().m
    assert (got[3].msgId, got[3].question, got[3].feedback, got[3].created_at) == ("9", "", "up", NOW)
    got = one.select(S.attach_feedback(F.col("m"), F.lit(None).cast("string"), F.lit("up"), NOW).alias("m")).first().m
    assert [x.feedback for x in got] == [None, None, "up"]  # blank serial meets a blank id
    got = one.select(S.attach_feedback(F.slice("m", 1, 2), F.lit(""), F.lit("up"), NOW, F.lit("fresh")).alias("m")).first().m
    assert got[2].msgId == "fresh"
    got = one.select(S.append_message(F.col("m"), "5", "q", "a", NOW).alias("m")).first().m
    assert len(got) == 4 and got[3].feedback is None
    got = one.select(S.hoist_created(F.col("m"), F.lit("c")).alias("m")).first().m
    assert [x.created_at for x in got] == ["c", "t", "t"]


def test_load_records(spark):
    msg = lambda c: [("1", "q", "a", None, c)]
    schema = f"session_id string, created_at string, messages array<{S.MESSAGE}>"
    local = spark.createDataFrame([("a", "c0", msg(None))], schema)
    remote = spark.createDataFrame([("a", None, msg("r")), ("b", "c1", msg("r"))], schema)
    got = {r.session_id: r.messages for r in S.load_records(spark.createDataFrame([("a",), ("b",), ("z",)], "session_id string"), local, remote).collect()}
    assert got["a"][0].created_at == "c0" and got["b"][0].created_at == "r" and got["z"] == []


def test_repair_and_put(spark):
    raw = ['[{"id":"a"}]', 'x [{"id":"a"},{"id":"b"}]}}}', "", "{}", "[broken]", '[{"id":"a"', None]
    got = [len(r.s) for r in spark.createDataFrame([(k, v) for k, v in enumerate(raw)], "k int, raw string").orderBy("k").select(S.repair_sessions(F.col("raw")).alias("s")).collect()]
    assert got[:3] == [1, 2, 0] and got[4:] == [0, 0, 0]
    sessions = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B")], "id string, position long, payload string")
    updates = spark.createDataFrame([("a", "A1", 0), ("a", "A2", 1), ("c", "C", 2)], "id string, payload string, seq long")
    out = S.put_sessions(sessions, updates)
    assert [(r.id, r.payload) for r in out.orderBy("position").collect()] == [("a", "A2"), ("b", "B"), ("c", "C")]
    assert S.session(out, "c").count() == 1 and S.session(out, "zz").count() == 0


def test_latest_rows(spark):
    rows = [("s", "m", "", "", "f", "9"), ("s", "m", "q", "a", None, "1"), ("s", "m", "q", "b", None, "2"), ("s", "n", "", "", None, "1")]
    assert sorted(tuple(r) for r in S.latest_rows(spark.createDataFrame(rows, ROWS)).collect()) == [("s", "m", "q", "b", None, "2"), ("s", "n", "", "", None, "1")]
