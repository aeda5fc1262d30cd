import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_langid(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id][0] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.95
    assert np.mean([r.rejected for r in held]) < 0.02
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_do_not_read_labels(spark, docs):
    model = langid.fit(langid.sample(docs, F.lit(True)))
    a = langid.identify(docs.select("doc_id", "text"), model).collect()
    b = langid.identify(docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("zz").alias("lang")), model).collect()
    assert [(r.lang_pred, r.score) for r in a] == [(r.lang_pred, r.score) for r in b]


def test_foreign_scripts_are_rejected(spark):
    model = langid.fit(langid.sample(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), F.lit(True)))
    _, _, rejected = model.predict(["zzzz qqqq xxxx", "абв гдеж зик лмно", "漢字 仮名", "", None, "12 !!"])
    assert rejected.all()
    assert model.predict(["", None, "12 !!"])[0] == ["und"] * 3


def test_number_signs_are_no_letters(docs):
    model = langid.fit(langid.sample(docs, F.lit(True)))
    assert model.predict(["½ ² ①", "Ⅷ", "_", "٣"])[0] == ["und"] * 4
    assert langid.UND not in model.predict(["ª", "ʰ", "漢", "é"])[0]


def test_every_language_is_learned(spark):
    # one text repeated in each of many languages, and one language of distinct texts
    one = spark.range(40_000).select(F.concat(F.lit("text number "), (F.col("id") % 40).cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 40).cast("string")).alias("lang"))
    many = spark.range(9000).select(F.concat(F.lit("viele Worte "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    got = langid.sample(one.union(many), F.lit(True), per_lang=20, most=410)
    assert {y for _, y in got} == {f"l{k}" for k in range(40)} | {"de"}
    assert sum(y == "de" for _, y in got) == 10


def test_scores_equal_the_formula():
    for n in (3, 30):  # the table holds the weights, or does not
        rng = np.random.default_rng(n)
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöñ"), 6)) for _ in range(n)]
        samples = [(f"{w} {w} {a}", f"l{k:02}") for k, w in enumerate(words) for a in words[:6]]
        model = langid.fit(samples)
        assert (model.weight is None) == (n == 3)
        texts = ["abc déf", words[0], "x" * 30_000, "ñ 1 ñ"]
        _, score, _ = model.predict(texts)
        for t, s in zip(texts, score):
            data = "".join(c if c.isalpha() and (ord(c) > 127 or c.islower()) else " " for c in t.lower()).encode()
            total, m = np.zeros(model.table.shape[1]), 0
            for order in langid.ORDERS:
                for at in range(len(data) + 1):  # a text's words end in blanks
                    gram = (data + langid.PAD)[at : at + order]
                    code = (int.from_bytes(gram, "big") + order * 0x51ED27) % 2**32 * 2654435761 % 2**32
                    total, m = total + model.table[(code ^ code >> 15) >> 17], m + 1
            z = (total / m if model.weight is None else total / m @ model.weight) + model.bias
            e = np.exp((z - z.max()) / model.temperature)
            assert abs((e / e.sum()).max() - s) < 1e-5, t[:20]


def test_long_texts_are_excerpts_in_the_sample(spark):
    rows = spark.createDataFrame([("a" * 100_000 + " end", "x"), ("short", "y")], "text string, lang string")
    got = dict((y, t) for t, y in langid.sample(rows, F.lit(True)))
    assert got["y"] == "short" and len(got["x"]) == langid.EXCERPT


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "abc def", "old", 7.0)], "doc_id long, text string, Lang_Pred string, score double")
    got = langid.identify(rows, langid.fit([("abc def ghi", "en"), ("uvw xyz rst", "de")] * 10))
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    assert got.first().lang_pred == "en"


def test_gradient_lowers_loss():
    samples = [("aaa bbb aab", "x"), ("ccc ddd ccd", "y")] * 20
    model = langid.fit(samples, epochs=8)
    assert model.predict(["aab aaa", "ddc ccc"])[0] == ["x", "y"]


def test_odd_rows(odd, nothing):
    assert langid.fit([]).predict(["some text"]) [0] == ["und"]
    model = langid.fit([("abc def ghi", "en"), ("uvw xyz rst", "de")] * 10)
    got = langid.recognised(odd, model)
    assert got.columns == odd.columns
    assert {r.doc_id for r in got.collect()} <= {4, 5, None}
    assert langid.recognised(nothing, model).count() == 0
    assert langid.sample(nothing, F.lit(True)) == []
    assert langid.identify(odd.select("doc_id", "text"), model).count() == odd.count()


def test_copies_leave_a_language_its_sample(spark):
    copies = spark.range(20_000).select(F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    few = spark.range(30).select(F.concat(F.lit("other words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    many = spark.range(5000).select(F.concat(F.lit("viele Worte "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    got = langid.sample(copies.union(few).union(many), F.lit(True), per_lang=50)
    assert len(got) == len(set(got))
    assert sorted(t for t, y in got if y == "en") == sorted({"the same words again", *(f"other words {k}" for k in range(30))})
    assert sum(y == "de" for _, y in got) == 50
