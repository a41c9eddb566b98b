"""From raw documents to packed training sequences; every stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcetrust.llm import exact_dedup, packing, simhash_dedup, suffix_dedup, toxicity
from sourcetrust.llm.queries import read, vocabulary
from sourcetrust.llm.tables import Workspace

TOXIC = 0.7  # texts scored at least this go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not call toxic."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, out="_score").filter(F.col("_score") < TOXIC).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by fingerprints of four-word shingles within four bits."""
    return simhash_dedup.drop_near_duplicates(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that stand anywhere else too."""
    left = suffix_dedup.drop_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, mixed over sources."""
    return packing.pack_sequences(docs, vocabulary("byte_bpe_50k.json"), kind="spaced", with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_passages),
    ("packing", pack),
]
# a trained classifier, components of near copies and byte spans are beyond SQL; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces made of all documents."""
    space, docs = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
