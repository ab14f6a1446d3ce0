"""The corpus pipeline: stages over documents, each one of the ten operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.llm import mixing, neardup, packing, quality, substring
from squelch.llm.queries import CAPACITY, tokenizer_path
from squelch.llm.shared import stored

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs.select(*DOCUMENT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id."""
    return neardup.keep_one(docs.select(*DOCUMENT))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat an earlier passage; ``n_chars`` follows the text."""
    return substring.cleaned(docs.select(*DOCUMENT)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or in up to three rows."""
    mixed = mixing.mix(docs.select(*DOCUMENT), keep=list(DOCUMENT)).filter("copies > 0")
    return mixed.select("doc.*", F.expr("explode(array_repeat(1, copies))").alias("copy")).select(*DOCUMENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence and its place there."""
    cut = packing.token_pieces(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), 1, CAPACITY)
    return packing.pack(cut, CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source weights", source_weights),
    ("packing", packed),
]
#: Tokenizing and packing can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
