"""The operators over the given tables, one query each, with the results their contracts fix."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from airstats.llm import (
    chat, decontaminate, html, idfile, jaccard, katz, licenses, merkle, pieces, quality, spelling, suffix, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(more)))


@query
def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


@query
def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = idfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return idfile.checksums(files)


@query
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found, tokens = katz.split_scores(docs, ~held_out)
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.item_digest(found)


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_texts(licenses.scanned(table(spark, sf_dir, "documents")))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.lettered(table(spark, sf_dir, "documents"))))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]

    def folded(docs: DataFrame) -> dict:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
        text = F.when(tampered, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
        return {"folded_leaf": merkle.row_digest(*[F.col(c) for c in columns[:-1]], text)}

    found = merkle.manifest(table(spark, sf_dir, "documents"), columns, carry=folded)
    root = merkle.proof_root(F.col("folded_leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
