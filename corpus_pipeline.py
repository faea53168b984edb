"""Training-data pipeline over ``documents``: toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.

In every stage null texts count as empty, rows with null or repeated ids are judged row by row (but for near
copies, where equal ids share their fate), texts of any length are read whole, ties go to smaller ids, an empty
table gives an empty one, and columns that are not named here are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import packing, simhash, suffix, toxicity
from driftline.llm.common import spool, table
from driftline.llm.queries import tokenizer_file


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity of 0.8 or more): the one with the smallest doc_id (of equal ids, all).

    The ids that go are fewer than those that stay, so texts are shuffled only where their table is too large to broadcast.
    """
    classes = simhash.similar_texts(docs)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    gone = spool(classes.select("doc_id").distinct().join(kept.distinct().withColumnRenamed("doc_id", "k"), F.col("doc_id").eqNullSafe(F.col("k")), "left_anti"), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that occur earlier; those cut to nothing go."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_file())


STAGES = [("toxicity", clean), ("near_copies", distinct), ("repeats", unrepeated), ("packing", packed)]
#: Neither hashing with XXH64 and components nor tokenizing can be said in SQL; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
