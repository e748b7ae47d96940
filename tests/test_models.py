"""Fitting, saving, scoring, tuning."""

import pytest
from pyspark.sql import functions as F

from airstats.operators.evaluate import class_metrics
from airstats.plans import models, scoring
from airstats.streaming.scoring import score_stream, write_scores


@pytest.fixture(scope="module")
def prepared(spark, flights):
    return models.prepare(flights, "flight_id")


@pytest.fixture(scope="module")
def separable(spark):
    """Four classes a model must be able to tell apart."""
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(800).select(
        "id", (F.col("id") % 4).cast("int").alias("delay_level"), ((F.col("id") % 4) * 50.0).alias("total_delay"),
        ((F.col("id") % 4) * 10.0 + F.col("id") % 7).alias("a"), (F.col("id") % 3).cast("double").alias("b"),
        F.lit(1.0).alias("weight"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


@pytest.mark.parametrize("fit", [
    lambda t: models.fit_logistic(t, C=100), lambda t: models.fit_ovr_logistic(t, C=100),
    lambda t: models.fit_boosted(t, 3, 3, 0.3)])
def test_models_learn(fit, separable):
    model = fit(separable)
    metrics = class_metrics(scoring.score(model, separable), "delay_level", "class").head()
    assert metrics.accuracy > 0.6
    again = scoring.score(fit(separable), separable)
    same = scoring.score(model, separable).select("id", "class").exceptAll(again.select("id", "class"))
    assert same.count() == 0


def test_linear_is_exact_on_a_line(separable):
    scored = scoring.expected_delay(models.fit_linear(separable.withColumn(
        "total_delay", F.col("a") * 2 + F.col("b") - 3)), separable)
    worst = scored.agg(F.max(F.abs(F.col("minutes") - (F.col("a") * 2 + F.col("b") - 3)))).head()[0]
    assert worst < 1e-6


def test_scaled_with_population_deviation_of_training_rows(prepared):
    train = prepared.rows.where("split = 'train'")
    scaled = models.scaler(train).transform(train)
    for c in ("crs_elapsed_time_z", "route_risk_z"):
        row = scaled.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).head()
        assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1)


def test_unseen_category_has_no_place(spark, prepared):
    one = prepared.rows.limit(1).withColumn("op_carrier", F.lit("never seen"))
    names = models.feature_names(prepared.train)
    vector = prepared.preprocessing.transform(one).head().features.toArray()
    assert names[:6] == ["crs_elapsed_time", "route_risk", "o_prcp", "o_wspd", "d_prcp", "d_wspd"]
    assert len(names) == len(vector)
    assert sum(v for n, v in zip(names, vector) if n.startswith("op_carrier_")) == 0
    assert sum(v for n, v in zip(names, vector) if n.startswith("season_")) == 1


def test_null_number_can_be_imputed(spark, prepared):
    train = prepared.rows.where("split = 'train'")
    pre = models.fit_preprocessing(train, on_null_number="impute")
    hole = train.limit(1).withColumn("o_wspd", F.lit(None).cast("double"))
    assert pre.transform(hole).head().features[3] == 0.0
    strict = models.fit_preprocessing(train)
    with pytest.raises(Exception):
        strict.transform(hole).collect()


def test_probabilities_add_up(prepared):
    scored = scoring.score(models.fit_ovr_logistic(prepared.train, max_iter=20), prepared.test)
    off = scored.where(F.abs(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count()
    assert off == 0 and scored.where("class NOT BETWEEN 0 AND 3").count() == 0


def test_save_load_compare_and_stream(spark, prepared, tmp_path):
    model = prepared.whole(models.fit_ovr_logistic(prepared.train, max_iter=20))
    scoring.save_model(model, str(tmp_path / "log"))
    scoring.save_model(prepared.whole(models.fit_linear(prepared.train)), str(tmp_path / "lin"))
    saved = {"log": (str(tmp_path / "log"), "classification"), "lin": (str(tmp_path / "lin"), "regression"),
             "none": (str(tmp_path / "none"), "classification")}
    table = {r.model: r for r in scoring.compare_models(saved, prepared.test_rows).collect()}
    assert set(table) == {"log", "lin"} and table["lin"].rmse > 0 and table["log"].rmse is None
    with pytest.raises(ValueError):
        scoring.compare_models({"none": saved["none"]}, prepared.test_rows)

    prepared.test_rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(prepared.test_rows.schema).parquet(str(tmp_path / "in"))
    write_scores(score_stream(model, stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = scoring.with_text(scoring.score(scoring.load_model(str(tmp_path / "log")), prepared.test_rows))
    columns = ["flight_id", "class", "prob", "class_text", "percent"]
    assert batch.select(columns).exceptAll(spark.read.parquet(str(tmp_path / "out")).select(columns)).count() == 0


def test_grid_order_and_failures():
    grid = models.param_grid(models.BOOSTED_GRID)
    assert len(grid) == 18 and grid[1] == {"learning_rate": 0.05, "max_depth": 3, "n_estimators": 200}
    assert [p["solver"] for p in models.param_grid(models.LOGISTIC_GRID)][:3] == ["lbfgs", "liblinear", "lbfgs"]


def test_grid_keeps_going_after_a_failure(prepared):
    def fit(train, C):
        if C == 1:
            raise RuntimeError("no luck")
        return models.fit_logistic(train, C, 10)

    tuned = models.grid_fit(fit, {"C": (1, 0.1)}, prepared.train, prepared.test)
    results = {r.C: r for r in tuned.results.collect()}
    assert results[1.0].error == "no luck" and results[1.0].recall_3 is None
    assert results[0.1].recall_3 >= 0 and tuned.model is tuned.models[next(iter(tuned.models))]


def test_importances(prepared):
    top = models.importances(models.fit_boosted(prepared.train, 2, 3, 0.1), prepared.train).collect()
    assert len(top) == 10 and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)


def test_first_splits_read_the_flights_once(spark, sf_dir, monkeypatch):
    """Means, codes, weights and bins come from tables written once; the joins of the flights are not made again for each."""
    from airstats.catalog import QUERIES, models as catalog

    seen, build = spark.sparkContext.accumulator(0), catalog.flights

    def counted(session, folder):
        def passed(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = build(session, folder)
        return rows.mapInArrow(passed, rows.schema)

    monkeypatch.setattr(catalog, "flights", counted)
    assert QUERIES["m5_first_splits"](spark, sf_dir).count() == 4
    assert seen.value == build(spark, sf_dir).count()
