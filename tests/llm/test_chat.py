import hashlib
import random

from pyspark.sql import functions as F

from tessella.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|user|>", "</s>\n", "<s>", "[INST]", "[/INST]", "<\\|x|\\>", "|>\n", "<\\\\/s>", "a", "\n", "<", "|", "[\\/INST]", "ü😀"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append(((-1 << 63) if turn is None else turn, role or "", text or ""))
    result = {}
    for conv, turns in out.items():
        turns.sort()
        targets = "".join(t for _, r, t in turns if r == "assistant")
        result[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(targets), sha(targets))
    return result


def digests(df, **options):
    rows = chat.digests(df, **options).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.FORGED), (-1, 1, "assistant", queries.FORGED)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op1_chat_format(spark, sf).collect()}
    assert got == expected(rows)


def test_any_text_is_read_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "<|x", None]), "".join(rng.choices(NASTY, k=rng.randrange(12)))) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(100, None, None, None), (100, 1, "assistant", None), (101, 1, "user", "same"), (101, 1, "user", "same")]
    rows += [(102, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 50)) for t in range(700)]
    rows += [(103, 0, "system", "rules"), (103, 1, "assistant", "word " * 20_000), (103, 2, "assistant", "tail")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(df, budget=64, history=12, system=12) == expected(rows)
    extra = df.withColumn("window", F.lit("x")).withColumn("block", F.lit(1)).withColumn("start", F.lit(2))
    assert digests(extra) == expected(rows)


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "assistant" if t % 2 == 0 else "user", "w " * (t % 7 + 1)) for t in range(1, 400)]
    windows = chat.read_turns(chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=100, history=20, system=20)).orderBy("segment", "window").collect()
    assert len(windows) > 5
    assert max(w.n_tokens for w in windows) <= 100
    assert sum(w.n_new for w in windows) == 400
    for w in windows[1:]:
        assert (w.turns[0].role, w.turns[0].text) == ("system", "be brief")
        assert w.n_context >= 2  # some history beside the system turn
    for w in windows:
        spans = [w.formatted[s.start : s.start + s.length] for s in w.loss]
        assert spans == [t.text for t in w.turns[w.n_context :] if t.role == "assistant"]


def test_windows_are_nearly_full(spark):
    text = " ".join(["word"] * 40)
    rows = [(1, t, "assistant" if t % 2 else "user", text) for t in range(2000)]
    rows += [(2, t, "user", " ".join(["w"] * (1 + 37 * t % 380))) for t in range(250)]
    got = chat.format_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    for conv, least in ((1, 0.8), (2, 0.6)):  # large turns of many sizes fill less
        fill = [w.n_tokens for w in got if w.conv_id == conv]
        assert max(fill) <= 1024 and sum(fill) / len(fill) > least * 1024
    assert sum(w.n_new for w in got) == 2250


def test_segments_carry_system_turn_and_history(spark):
    rows = [(1, t, "system" if t in (0, 256) else "assistant" if t % 2 else "user", f"t{t} " * (t % 9 + 1)) for t in range(600)] + [(2, t, "system" if t == 256 else "user", f"u{t}") for t in range(300)]
    got = chat.read_turns(chat.format_windows(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "segment", "window").collect()
    seen = {1: 0, 2: 0}
    for w in got:
        texts = [t.text for t in w.turns]
        mine = [r[3] for r in rows if r[0] == w.conv_id]
        fresh = texts[w.n_context :]
        assert fresh == mine[seen[w.conv_id] : seen[w.conv_id] + w.n_new]
        context = texts[: w.n_context]
        if w.conv_id == 1 and seen[1]:
            assert context[0] == mine[0]
            context = context[1:]
        at = seen[w.conv_id]
        assert context == mine[at - len(context) : at] and (not at or context)
        seen[w.conv_id] += w.n_new
    assert seen == {1: 600, 2: 300} and len({w.segment for w in got if w.conv_id == 1}) == 3


def test_main_path_has_no_python(spark, sf):
    plan = queries.op1_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_null_conversation_and_empty_table(spark):
    got = chat.digests(spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b")], SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(None, 2, 1)]
    assert chat.digests(spark.createDataFrame([], SCHEMA)).count() == 0
