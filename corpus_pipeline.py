"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before has left and gives documents with the same columns (doc_id, text, lang, source,
n_chars); the last one gives pieces of sequences. Between stages the documents are a Parquet table in the shared folder, so a lost
executor repeats part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.near import near_duplicates
from rollbook.llm.packing import pack
from rollbook.llm.quality import classify, fit_classifier
from rollbook.llm.repeats import remove_repeats
from rollbook.llm.rules import FULL, fails, quality_ledger
from rollbook.session import free_stage, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, takes for prose. Texts without words go."""
    judged = classify(docs, fit_classifier(docs), keep=REST)
    return judged.where("kept").withColumnRenamed("id", "doc_id").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the full policy. A null or empty text has no words and goes; repeated rows stay or go together."""
    ledger = quality_ledger(docs, keep=REST)
    return ledger.where(~fails(FULL)).withColumnRenamed("id", "doc_id").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id, once if it is repeated with the same text (of rows that differ
    in other columns, the first in their order). Rows without an id stay."""
    near = near_duplicates(docs)
    gone = near.where("id IS NOT NULL AND NOT kept").select(F.col("id").alias("doc_id")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("first"))
    return named.select("doc_id", "text", "first.*").select(COLUMNS).unionByName(docs.where("doc_id IS NULL").select(COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated strings of 200 bytes; a character that loses some of its bytes goes whole. All rows stay; a null
    text becomes an empty one."""
    cut = remove_repeats(docs.select(COLUMNS), characters=True)
    return cut.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens. A null or empty text is one piece, the end token; rows with equal
    ids are packed each for itself."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Scores, signatures and tokens are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if k:
            free_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
