"""Least squares and one-vs-rest logistic regression against numpy over all rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from airstats.catalog.models import gradient_vanishes
from airstats.plans import linear, models, scoring


@pytest.fixture(scope="module")
def prepared(spark, flights):
    return models.prepare(flights, "flight_id")


def matrix(train, *more):
    rows = train.select(vector_to_array("features").alias("x"), *more).collect()
    x = np.array([r.x for r in rows])
    return np.hstack([x, np.ones((len(x), 1))]), *(np.array([r[c] for r in rows], float) for c in more)


def test_least_squares(prepared):
    x, y = matrix(prepared.train, "total_delay")
    wanted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    model = models.fit_linear(prepared.train.repartition(5))
    assert np.allclose(x @ model.matrix()[0], wanted, atol=1e-6)
    # every category leaves out one of its 0/1 columns beside the constant
    gram = x.T @ x
    taken = linear.independent_columns(gram)
    assert len(taken) == np.linalg.matrix_rank(x) < len(gram) and len(gram) - 1 in taken


def test_independent_columns():
    x = np.array([[1.0, 2, 0, 1], [2, 4, 0, 1], [3, 6, 0, 1], [5, 10, 0, 1]])
    assert sorted(linear.independent_columns(x.T @ x)) in ([0, 3], [1, 3])


@pytest.mark.parametrize("C", [0.01, 1.0, 100.0])
def test_gradient_is_zero_at_the_solution(prepared, C):
    x, y = matrix(prepared.train, "delay_level")
    weights = models.fit_ovr_logistic(prepared.train, C).matrix()
    for c, w in enumerate(weights):
        sign = np.where(y == c, 1.0, -1.0)
        share = np.where(y == c, len(y) / (2 * (y == c).sum()), len(y) / (2 * (y != c).sum()))
        gradient = lambda w: w + C * x.T @ (-share * sign / (1 + np.exp(sign * (x @ w))))
        assert np.linalg.norm(gradient(w)) < 1e-6 * np.linalg.norm(gradient(0 * w))


def test_gradient_of_rows_that_share_a_key(spark):
    """Copies of a key count once each, and no row travels to be joined."""
    rows = [(None if i % 7 == 0 else i // 2, float(i % 10), float(i % 3), i % 4) for i in range(80)]
    df = spark.createDataFrame(rows, "flight_id long, a double, b double, delay_level int")
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    fitted = models.fit_ovr_logistic(vectors).matrix()
    checked = gradient_vanishes(vectors, fitted)
    assert {(r["class"], r.solved) for r in checked.collect()} == {(c, True) for c in range(4)}
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert not any(r.solved for r in gradient_vanishes(vectors, fitted + 0.01).collect())


def test_a_class_that_does_not_occur(spark):
    df = spark.createDataFrame([(float(i), i % 2, 1.0) for i in range(40)], "a double, delay_level int, weight double")
    vectors = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    model = models.fit_ovr_logistic(vectors)
    assert model.matrix().shape == (4, 2) and np.isfinite(model.matrix()).all()
    assert {r["class"] for r in scoring.score(model, vectors).collect()} <= {0, 1}


def test_scores_of_whole_batches(prepared):
    """Vectors are scored as one matrix per Arrow batch, not as an object a row."""
    model = models.fit_linear(prepared.train)
    scored = model.transform(prepared.train.select("features"))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in scored._jdf.queryExecution().executedPlan().toString()
    x, got = matrix(scored, "minutes")
    assert np.allclose(x @ model.matrix()[0], got, atol=1e-9)


def test_save_and_load(spark, prepared, tmp_path):
    for model, column in ((models.fit_linear(prepared.train), "minutes"), (models.fit_ovr_logistic(prepared.train), "prediction")):
        PipelineModel([model]).write().overwrite().save(str(tmp_path / "model"))
        one, other = (m.transform(prepared.test).select(column).collect() for m in (model, PipelineModel.load(str(tmp_path / "model"))))
        assert one == other
