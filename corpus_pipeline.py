"""From raw documents to token counts, in stages that each write what they keep.

Each stage is a function of the session, the documents kept so far and the folder of the tables; its
result is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents. Null and empty texts go in the first stage, as texts without words do.

A document is a doc_id with its text, either of which may be null: rows that share an id but not the
text are judged each by its own text, and rows equal in both are one document from the second stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airstats.llm import decontaminate, jaccard, pieces, quality, suffix
from airstats.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that must not stand twice: about 50 words, where op 7's contract asks for 400 bytes.
PASSAGE_BYTES = 280


def _row() -> Column:
    """What tells documents apart, null ids and shared ids included, as a 64-bit hash."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``row``."""
    return docs.select(*COLUMNS, _row().alias("row"))


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs``, numbered, whose ``row`` is in ``rows``."""
    return docs.join(rows.select("row"), "row", "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.select(F.struct("doc_id", _row().alias("row")).alias("key"), "text")
    verdicts = quality.judge(keyed, labels, key="key", row_key="key.doc_id")
    return _kept(_numbered(docs), verdicts.where("kept").select("key.row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least key, of each group of near copies; one without a key only if none has one."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _row().alias("row"))
    found = jaccard.near_copies(docs.select(key.alias("key"), "text"), key="key")
    return _kept(_numbered(docs).dropDuplicates(["row"]), found.where("key = component_id").select("key.row"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``PASSAGE_BYTES`` bytes that occur elsewhere too; blank ones go."""
    numbered = _numbered(docs).dropDuplicates(["row"])
    left = suffix.without_repeats(numbered.select("row", "text"), key="row", length=PASSAGE_BYTES)
    left = left.select("row", F.col("kept_text").alias("text")).where(r"text rlike '[^ \\t-\\r]'")
    return (numbered.drop("text", "n_chars").join(left, "row")
            .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    numbered = _numbered(docs)
    found = decontaminate.contamination(numbered.select("row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    return _kept(numbered, found.where(F.size("hits") == 0))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The forest and the model's ids are no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
