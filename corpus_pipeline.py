"""The corpus pipeline: each stage takes what the one before kept, and its decisions take effect.

Every stage but the last returns the columns of documents, whatever they are, and an empty table for an empty
one. Rows may repeat, lack an id or a text, or hold very long texts; each stage states what it does with them.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, decontam, langid, minhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not call toxic.

    Defined cases: null and empty texts have no clause and stay; rows without an id are judged like others, and
    teach nothing; repeated rows fare alike; a long text is judged whole; without labels none is toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs.select("doc_id", "text"), labels, common.id_remainder(F.col("doc_id"), 4) != 2)
    return toxicity.keep(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a margin of langid.MARGIN or more.

    Defined cases: null texts and those without a letter have no language and go; so do texts whose two best
    languages tie; where no row has a language, none can be told and all go; repeated rows fare alike.
    """
    content = langid.learn(docs.select("doc_id", "text", "lang"), common.id_remainder(F.col("doc_id"), 3) != 1)
    return langid.keep(docs, content)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of least id.

    Defined cases: of rows that repeat an id and a text one stays; an id with several texts is several documents;
    rows without an id come after all others in order, by hash of their text, so one of equal texts stays; texts
    without words are near copies of nothing, and one row of each id stays. No other column decides.
    """
    # an id of its own for each text without one, above those that are given
    key = F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    found = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), size=5, percent=80)
    kept = found.where("kept").groupBy(F.col("doc_id").alias("_key"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_times"))
    rows = docs.withColumns({"_key": key, "_hash": F.xxhash64("text")}).join(kept, ["_key", "_hash"])
    once, often = rows.where("_times = 1"), rows.where("_times > 1").dropDuplicates(["_key", "_hash"])
    return once.unionByName(often).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Defined cases: null and empty texts hold none and stay; without items all stay; repeated rows fare alike.
    """
    return decontam.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digest of the bytes decoded from them.

    Defined cases: null and empty texts have no tokens; rows without an id keep a null id; rows stay as many.
    """
    found = bpe.tokenize(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", encode),
]

#: Learned scores, compression sizes and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = STAGES[:-1]
    docs = reduce(lambda d, step: scratch.keep(step[1](spark, d, sf_dir), step[0]), steps, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
