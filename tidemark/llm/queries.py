"""The registered queries of these operators, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, common, decontam, html, langid, license, lm, minhash, ogg, toxicity

QUERIES = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn):
    """Register under the function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_ogg(spark, d):
    stored = ogg.with_media(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "media")
    return ogg.digests(ogg.read_media(stored))


@query
def op2_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, d, "labels"), common.id_remainder(F.col("doc_id"), 4) != 2)
    return toxicity.rate(docs, model).withColumn("held_out", common.id_remainder(F.col("doc_id"), 4) == 2)


@query
def op3_minhash(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"), size=3, percent=85)


@query
def op4_lm(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lm.score(docs, common.id_remainder(F.col("doc_id"), 10) != 0)


@query
def op5_decontamination(spark, d):
    return decontam.find(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


@query
def op6_chat(spark, d):
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.unpack(chat.pack(rows, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN))


@query
def op7_bpe(spark, d):
    return bpe.digests(table(spark, d, "documents").select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN)


@query
def op8_license(spark, d):
    return license.scan(table(spark, d, "documents").select("doc_id", "text"))


@query
def op9_html(spark, d):
    return html.main_text(table(spark, d, "pages").select("page_id", "url", "html"))


@query
def op10_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = common.id_remainder(F.col("doc_id"), 3) == 1
    content = langid.learn(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), content).withColumn("held_out", held_out)


ORACLES["op8_license"] = license.sql()
