import zlib

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """Documents with hard rows added, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    most = docs.orderBy("doc_id").limit(120)
    hard = [None, "", " ", "\n\n", "a", "one two three", "x " * 4000, "né è  ß\t" * 30, "▁ ▁▁ a", "a\r\n\x0bb\x00c",
            "Of " * 200, "aaaa" * 300, "#$%" * 5, "tail\n", "same line\nsame line\n\nother\nsame line", "😀 " * 12]
    rows = [(10_000 + i, t) for i, t in enumerate(hard + hard[:4])]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    return most.unionByName(extra).withColumns({
        "key": F.lit(None).cast("string"), "row": F.lit(1), "lang": F.lit("en"), "score": F.lit(0.5), "n": F.lit(2)}).cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


def crc(key) -> int:
    return zlib.crc32(str(key).encode())
