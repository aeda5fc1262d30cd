"""One registered query for each training-data operator, over whole tables.

Each digest contract is derived here; the operators themselves keep their own
interface and return texts, spans and tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, chat, decontaminate, langid, lines, lm, oracles, pieces, pii, quality, simhash
from tessella.llm.common import doc_text, held_out, table

FORGED = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(FORGED).alias("text"))
    return chat.digests(rows.unionByName(forged))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.default_model(), texts=False)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return quality.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(doc_text(table(spark, sf_dir, "documents")), counts=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(7, 2))
    model, counts = lm.train(docs, ~F.col("held_out"))
    return lm.score(docs, model, counts, ["held_out"])


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs, ~held_out(5, 0)))
    rows = doc_text(docs).withColumn("held_out", held_out(5, 0))
    return langid.identify(rows, model).drop("text")


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ann": op3_ann,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_lm": op9_lm,
    "op10_langid": op10_langid,
}

#: SQL cannot express the other eight (trained models, XXH64, a tokenizer's merges, content-defined chunks): tests/llm holds them against brute force.
ORACLES = {"op1_chat_format": oracles.op1(FORGED), "op7_decontaminate": oracles.OP7}
