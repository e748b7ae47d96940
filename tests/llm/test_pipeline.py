import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_decontaminate import by_hand as contaminated
from test_jaccard import by_hand as groups
from test_suffix import by_hand as without_repeats

from airstats.storage import stored


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before the first stage and after each."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), "stage"))
    return out


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_columns_and_counts(stages):
    for docs in stages[:-1]:
        assert docs.columns == corpus_pipeline.COLUMNS
    counts = [d.count() for d in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2


def test_near_copies(stages):
    before = texts_of(stages[1])
    assert texts_of(stages[2]) == {k: before[k] for k, (_, c) in groups(before).items() if k == c}


def test_repeated_passages(stages):
    want = {k: v[0].decode("utf-8", "ignore") for k, v in without_repeats(texts_of(stages[2]), corpus_pipeline.PASSAGE_BYTES).items()}
    assert texts_of(stages[3]) == {k: t for k, t in want.items() if t.strip(" \t\n\r\x0b\x0c")}
    assert stages[3].where(F.length("text") != F.col("n_chars")).isEmpty()


def test_decontamination(stages, spark):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    before = texts_of(stages[3])
    assert set(texts_of(stages[4])) == {k for k, t in before.items() if not contaminated(t, items)[-1]}


def test_pieces(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in stages[5].collect()}
    for key, text in texts_of(stages[4]).items():
        ids = np.array(library.encode(text, add_bos=True, add_eos=True), "<u4")
        assert got[key]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()


def test_quality_rejects_by_rule(stages):
    kept = set(texts_of(stages[1]))
    for key, text in texts_of(stages[0]).items():
        if len(text.split()) < 10:
            assert key not in kept


def test_run(stages, spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    want = stages[-1].toPandas().sort_values("doc_id")
    assert got.to_numpy().tolist() == want.to_numpy().tolist()


def test_odd_documents(documents, spark, tmp_path):
    """Nulls, empty texts, repeated rows and more columns than the stages know."""
    sf_dir = "/root/testdata/sf0.001"
    docs = documents.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"),
                            F.length("text").cast("long").alias("n_chars"), "key", "row")
    docs = docs.union(docs.where("doc_id < 3"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    keys = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(keys) == len(set(keys)) and len(keys) > 50


def test_null_and_shared_ids(spark, tmp_path):
    """Documents without an id stay if they are clean; of one id, each text counts by itself."""
    sf_dir = "/root/testdata/sf0.001"

    def said(seed):
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(60))

    rows = [(None, said(1)), (None, said(1) + " more"), (7, said(2)), (7, said(3)), (8, said(2) + " end"),
            (9, said(4)), (9, said(4)), (None, said(5)), (10, "too short"), (None, "too short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({
        "lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
    first = [t for k, t in got if k == 0 and t.startswith(said(1))]
    assert len(first) == 1
    assert got == sorted([(0, first[0]), (0, said(5)), (7, said(2)), (7, said(3)), (9, said(4))])
