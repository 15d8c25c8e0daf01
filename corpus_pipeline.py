"""From raw documents to packed training sequences.

Five stages, each over all rows that its predecessor kept: language identification drops
documents without a recognisable language, lines that many documents share go, one document
of each group of near-duplicates stays, sources are mixed to their target weights (documents
repeat as often as the mix takes them), and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import forget, scratch
from trawl.llm.op2_language import keep_recognised
from trawl.llm.op3_simhash import keep_one
from trawl.llm.op6_mixing import mix
from trawl.llm.op7_lines import drop_lines
from trawl.llm.op8_packing import pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: words of a shingle, and bits in which fingerprints may differ. Changing one
#: word of a text of 300 moves about four bits, unrelated texts differ in about 32.
SHINGLE, RADIUS = 5, 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with no letters, or whose language the model cannot tell."""
    return keep_recognised(docs).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in at least ten documents."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, by shingles of five words: linked
    are fingerprints within RADIUS bits and texts with a Jaccard similarity of 0.8 or more."""
    return keep_one(docs, shingle=SHINGLE, radius=RADIUS, similar=True).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come to their target weights."""
    return mix(docs).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences of 2048 tokens; a row per piece."""
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Tokens and learned languages are not expressible in SQL; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        docs.stored_at = path
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
