import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airstats.llm import text as T
from airstats.llm import toxicity


@pytest.fixture(scope="module")
def table(spark):
    """Clean rows, and rows with one of a few stems somewhere; no column but the text tells them apart."""
    rng = np.random.default_rng(1)
    stems = ["vilon", "krasch", "mugget"]
    rows = []
    for i in range(700):
        words = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(rng.integers(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.integers(len(words))] = rng.choice(stems) + "".join(rng.choice(list("xyz"), 2))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


@pytest.fixture(scope="module")
def model(table):
    return toxicity.train(table.drop("toxic"), table.where("doc_id >= 300").select("doc_id", "toxic"))


def test_held_out(table, model):
    got = toxicity.scored(table.drop("toxic"), model).join(table, "doc_id").where("doc_id < 300").toPandas()
    assert len(got) == 300
    assert got.predicted[got.toxic == 1].mean() > 0.9
    assert got.predicted[got.toxic == 0].mean() < 0.1
    assert ((got.score >= 0.5) == got.predicted).all()


def test_odd_rows_and_ties(documents, model):
    got = toxicity.scored(documents, model).toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and len(got) == documents.count()
    empty = got.score[[10_000, 10_001, 10_002]]
    assert empty.nunique() == 1
    alone = toxicity.scored(documents.where("doc_id = 0"), model).toPandas()
    assert alone.score[0] == pytest.approx(got.score[0], abs=1e-5)


def test_only_the_text_counts(documents, model):
    other = documents.withColumn("lang", F.lit("xx")).withColumn("doc_id", -F.col("doc_id") - 1)
    a = toxicity.scored(documents, model).toPandas().set_index("doc_id").score
    b = toxicity.scored(other, model).toPandas().set_index("doc_id").score
    assert np.allclose(a.to_numpy(), b[-a.index - 1].to_numpy(), atol=1e-6)


def test_one_kind_or_none(documents, no_documents, spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.train(documents, labels) == 1.0
    assert toxicity.train(documents, labels.limit(0)) == 0.0
    assert toxicity.scored(documents, 0.0).agg(F.max("score")).first()[0] == 0
    assert toxicity.scored(no_documents, 0.0).count() == 0


def test_pooling_stays_within_texts():
    block = next(T.blocks(pa.array(["a b c", "", "d", None, "e f"])))
    texts = toxicity.Texts.of(block)
    values = np.arange(5, dtype=np.float32)[:, None] + 1
    best, has = toxicity._pooled(values, texts.bounds, 2)
    assert best[:, 0].tolist() == [2, 0, 0, 0, 5] and has.tolist() == [0, 4]


def test_thresholds_count_all_labelled_rows(table):
    # rows beyond the learnt ones in which a stem is clean more often than not
    more = table.where("toxic = 1").crossJoin(table.sparkSession.range(1, 4)).select(
        (F.col("doc_id") + 1000 * F.col("id")).alias("doc_id"), "text", F.lit(0).alias("toxic"))
    rows = table.union(more)
    model = toxicity.train(rows.drop("toxic"), rows.select("doc_id", "toxic"), toxic_rows=100, clean_rows=100)
    got = toxicity.scored(rows.drop("toxic"), model).join(rows.select("doc_id", "toxic"), "doc_id").toPandas()
    score, toxic = got.score.to_numpy(), got.toxic.to_numpy()
    least = min(((score >= cut) != toxic).sum() for cut in [*np.unique(score), 2])
    assert ((got.predicted != got.toxic).sum()) <= least + 2
