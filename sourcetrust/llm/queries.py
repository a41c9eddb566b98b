"""One query per operator over its whole table; columns as the contracts name them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcetrust.llm import (
    bpe, chat, collocations, embedding_dedup, exact_dedup, fill_middle, fingerprints, packing, simhash_dedup, suffix_dedup,
    token_counts, token_files, toxicity,
)
from sourcetrust.llm.tables import Workspace


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs).select("doc_id", "dedup.*")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_dedup.near_duplicates(docs)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    held_out = toxicity.held_out(F.col("doc_id"))
    predicted = (F.col("score") >= 0.7).cast("int")
    return toxicity.score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.repeated_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack_sequences(docs, vocabulary("byte_bpe_50k.json"), kind="spaced", with_ids=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{Workspace(spark, 'token-files').folder}/files"
    token_files.write_token_files(docs, folder, vocabulary("word_bpe_49k.json"), end_id=2, kind="words")
    return token_files.read_token_files(spark, folder, with_ids=False)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, vocabulary("word_bpe_49k.json"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(read(spark, sf_dir, "conversations"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(output, form), 256).alias("restored_sha256"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprint_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.withColumnRenamed("id", "doc_id").drop("next_id", "gone", "added")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_simhash_dedup, op3_embedding_dedup, op4_toxicity, op5_suffix_dedup, op6_packing, op7_token_counts,
    op8_token_files, op9_bpe, op10_chat_formatting, op11_collocations, op12_fill_middle, op13_fingerprints,
)}
