"""Model fitting, tuning, evaluation and scoring over the flights."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airstats.binding import KEY, flights
from airstats.catalog.registry import query
from airstats.catalog.relational import _FEATURES_BASE, _FEATURES_SQL, _level, _with_total
from airstats.operators.evaluate import class_report, regression_report
from airstats.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, build_features, with_targets
from airstats.operators.filters import clean_for_model
from airstats.operators.split import CLASSES, with_balanced_weight
from airstats.plans import boosting, models, scoring, service
from airstats.storage import scratch_path, spread, stored
from airstats.streaming.scoring import score_stream, write_scores

T = TypeVar("T")
_DONE: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, make: Callable[[SparkSession, str], T]) -> T:
    """What ``make`` returned for this session and folder: models that several queries read are fitted once."""
    place = (spark.sparkContext.applicationId, sf, make.__name__)
    if place not in _DONE:
        _DONE[place] = make(spark, sf)
    return _DONE[place]


def prepared(spark: SparkSession, sf: str) -> models.Prepared:
    """All flights, split and encoded."""
    return models.prepare(flights(spark, sf), KEY)


def boosted(spark: SparkSession, sf: str) -> tuple[models.Prepared, models.BoostedModel]:
    p = prepared(spark, sf)
    return p, models.fit_boosted(p.train)


@query("f9_one_hot", _FEATURES_SQL + "---" + " UNION ALL ".join(
    f"SELECT concat('{c}_', cast({c} AS varchar)) AS feature, count(*) AS n FROM features GROUP BY 1"
    for c in CATEGORICAL_FEATURES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = build_features(flights(spark, sf), fit_on="all")
    hot = models.encoder().fit(rows).transform(rows)
    vectors = VectorAssembler(
        inputCols=[f"{c}_hot" for c in CATEGORICAL_FEATURES], outputCol=models.FEATURES).transform(hot)
    names = F.array(*[F.lit(n) for n in models.feature_names(vectors)])
    counts = vectors.select(vector_to_array(Summarizer.numNonZeros(F.col(models.FEATURES))).alias("n"))
    return counts.select(F.inline(F.arrays_zip(names.alias("feature"), F.col("n")))).select(
        "feature", F.col("n").cast("bigint").alias("n"))


def _scaled(c: str) -> str:
    return f"""round(({c} - (SELECT avg({c}) FROM features)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1
      ELSE stddev_pop({c}) END FROM features), 5) AS {c}"""


@query("f11_feature_vector", _FEATURES_SQL + "--- SELECT flight_id, "
       + ", ".join(_scaled(c) for c in NUMERIC_FEATURES)
       + f", cast({len(CATEGORICAL_FEATURES)} AS int) AS ones FROM features")
def _(spark, sf):
    rows = build_features(flights(spark, sf), [KEY], fit_on="all")
    vectors = models.fit_preprocessing(rows, on_null_number="skip").transform(rows).select(
        KEY, vector_to_array(models.FEATURES).alias("v"))
    n = len(NUMERIC_FEATURES)
    hot = F.filter(F.slice("v", n + 1, F.size("v") - n), lambda x: x == 1.0)
    return vectors.select(
        KEY, *[F.round(F.col("v")[i], 5).alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
        F.size(hot).alias("ones"))


@query("m2_fit_linear")
def fit_linear(spark, sf):
    p = prepared(spark, sf)
    preds = scoring.expected_delay(models.fit_linear(p.train), p.test)
    report = class_report(preds, models.LABEL, "class")
    fit = regression_report(preds, models.TARGET, "minutes").agg(
        F.struct(F.first("rmse").alias("rmse"), F.first("r2").alias("r2"))).scalar()
    return report.withColumns({"rmse": fit["rmse"], "r2": fit["r2"]})


@query("m2_fit_linear_one_feature", _FEATURES_BASE + """,
  line AS (SELECT regr_slope(total_delay, crs_elapsed_time) AS slope,
    regr_intercept(total_delay, crs_elapsed_time) AS start FROM base)
  --- SELECT flight_id, round((SELECT start FROM line) + (SELECT slope FROM line) * crs_elapsed_time, 5) AS minutes
  FROM base""")
def _(spark, sf):
    rows = _with_total(flights(spark, sf)).select(KEY, "crs_elapsed_time", models.TARGET)
    vectors = VectorAssembler(inputCols=["crs_elapsed_time"], outputCol=models.FEATURES).transform(rows)
    return models.fit_linear(vectors).transform(vectors).select(KEY, F.round("minutes", 5).alias("minutes"))


# Within categories, so less their means, three numbers are solved for by Cramer's rule; the error left is that of a fit
# with a 0/1 column for each category.
_THREE = ("crs_elapsed_time", "o_wspd", "d_prcp")
_CATEGORY_FIT = _FEATURES_SQL + """,
  centred AS (SELECT total_delay AS whole, total_delay - avg(total_delay) OVER c AS y, """ + ", ".join(
    f"{x} - avg({x}) OVER c AS x{i}" for i, x in enumerate(_THREE)) + """ FROM features WINDOW c AS (PARTITION BY season)),
  s AS (SELECT count(*) AS n, sum(y * y) AS yy, var_pop(whole) * count(*) AS total, """ + ", ".join(
    f"sum(x{i} * x{j}) AS a{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"sum(x{i} * y) AS b{i}" for i in range(3)) + """
    FROM centred),
  d AS (SELECT *, a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20) AS det,
    b0 * (a11 * a22 - a12 * a21) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a21 - a11 * b2) AS d0,
    a00 * (b1 * a22 - a12 * b2) - b0 * (a10 * a22 - a12 * a20) + a02 * (a10 * b2 - b1 * a20) AS d1,
    a00 * (a11 * b2 - b1 * a21) - a01 * (a10 * b2 - b1 * a20) + b0 * (a10 * a21 - a11 * a20) AS d2 FROM s),
  e AS (SELECT n, total, yy - (d0 * b0 + d1 * b1 + d2 * b2) / det AS error FROM d)
  --- SELECT round(sqrt(error / n), 4) AS rmse, round(1 - error / total, 6) AS r2, n FROM e"""


@query("m2_normal_equations", _CATEGORY_FIT)
def _(spark, sf):
    """A fit on three numbers and all 0/1 columns of a category, which make up the constant."""
    rows = build_features(flights(spark, sf), fit_on="all")
    hot = models.encoder(["season"]).fit(rows).transform(rows)
    vectors = VectorAssembler(inputCols=[*_THREE, "season_hot"], outputCol=models.FEATURES).transform(hot)
    vectors = stored(vectors.select(models.FEATURES, models.TARGET), "vectors")
    report = regression_report(models.fit_linear(vectors).transform(vectors), models.TARGET, "minutes")
    return report.select(F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), "n")


def gradient_vanishes(train: DataFrame, fitted: Sequence[Sequence[float]]) -> DataFrame:
    """By class, whether the penalised loss's gradient at the weights ``fitted`` is 0, measured by that at none.

    A row's margins and slopes are figured from its own vector, so rows are neither joined nor shuffled.
    """
    spark, label = train.sparkSession, F.col(models.LABEL)
    table = [[float(w) for w in of_class] for of_class in fitted]
    counts = train.agg(F.struct(F.count("*").alias("n"), *[F.count_if(label == c).alias(f"c{c}") for c in CLASSES])).scalar()
    rows = train.select(models.LABEL, F.concat(vector_to_array(models.FEATURES), F.array(F.lit(1.0))).alias("x")).withColumn(
        "margins", F.transform(F.array(*[F.lit(of_class) for of_class in table]), lambda weights: F.aggregate(
            F.zip_with("x", weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)))

    def slopes(c: int) -> list[Column]:
        own, yes = label == c, counts[f"c{c}"]
        sign = F.when(own, 1.0).otherwise(-1.0)
        share = counts["n"] / (2 * F.when(own, yes).otherwise(counts["n"] - yes))
        return [(-share * sign / (1 + F.exp(sign * F.col("margins")[c]))).alias(f"slope{c}"), (-share * sign / 2).alias(f"start{c}")]

    entries = rows.select(*[s for c in CLASSES for s in slopes(c)], F.posexplode("x").alias("place", "x")).where("x <> 0")
    sums = entries.groupBy("place").agg(*[F.sum(F.col("x") * F.col(f"{s}{c}")).alias(f"{s}{c}") for c in CLASSES for s in ("slope", "start")])
    by_class = sums.select("place", F.inline(F.array(*[F.struct(
        F.lit(c).alias("class"), F.col(f"slope{c}").alias("g"), F.col(f"start{c}").alias("g_0")) for c in CLASSES])))
    weights = spark.createDataFrame([(c, i, w) for c, of_class in zip(CLASSES, table) for i, w in enumerate(of_class)],
                                    "class int, place int, w double")
    return by_class.join(weights, ["class", "place"]).groupBy("class").agg(
        (F.sqrt(F.sum(F.pow(F.col("g") + F.col("w"), 2.0))) < 1e-6 * F.sqrt(F.sum(F.pow("g_0", 2.0)))).alias("solved"))


@query("m4_gradient_vanishes", """--- SELECT cast(c AS int) AS class, true AS solved FROM range(4) t(c)""")
def _(spark, sf):
    """Gradient of each class's penalised loss at the weights fitted, summed up in Spark SQL, against that at none."""
    p = prepared(spark, sf)
    return gradient_vanishes(p.train, models.fit_ovr_logistic(p.train).matrix())


@query("m3_fit_logistic")
def fit_logistic(spark, sf):
    p = prepared(spark, sf)
    return class_report(scoring.score(models.fit_logistic(p.train), p.test), models.LABEL, "class")


@query("m4_fit_ovr_logistic")
def fit_ovr_logistic(spark, sf):
    p = prepared(spark, sf)
    return class_report(scoring.score(models.fit_ovr_logistic(p.train), p.test), models.LABEL, "class")


@query("m5_fit_boosted")
def fit_boosted(spark, sf):
    p, model = once(spark, sf, boosted)
    return class_report(scoring.score(model, p.test), models.LABEL, "class")


# Root splits of the first tree of each class: sums of gradient and Hessian left of every cut. All classes are
# equally likely before the first tree, so the gradient is 1/4 less 1 for the own class, times the balanced weight.
_NUMBERS = ", ".join(NUMERIC_FEATURES)
_FIRST_SPLITS = _FEATURES_SQL + f""",
  sizes AS (SELECT delay_level, count(*) AS n FROM features GROUP BY 1),
  weighed AS (SELECT f.*, (SELECT count(*) FROM features) / ((SELECT count(*) FROM sizes) * cast(s.n AS double)) AS w
    FROM features f JOIN sizes s ON s.delay_level = f.delay_level),
  graded AS (SELECT {_NUMBERS}, {", ".join(CATEGORICAL_FEATURES)},
    round_even(0.375 * w * 1048576, 0) / 1048576 AS h, {", ".join(
        f"round_even((0.25 - CASE WHEN delay_level = {c} THEN 1 ELSE 0 END) * w * 1048576, 0) / 1048576 AS g{c}" for c in range(4))}
    FROM weighed),
  whole AS (SELECT sum(h) AS h, {", ".join(f"sum(g{c}) AS g{c}" for c in range(4))} FROM graded),
  cells AS ({" UNION ALL ".join(
      f"SELECT {i} AS place, '{c}' AS feature, cast({c} AS double) AS x, count(*) AS n, sum(h) AS h, "
      + ", ".join(f"sum(g{k}) AS g{k}" for k in range(4)) + f" FROM graded GROUP BY {c}"
      for i, c in enumerate(NUMERIC_FEATURES))}),
  ranked AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY x) AS upto, sum(n) OVER (PARTITION BY feature) AS total,
    max(x) OVER (PARTITION BY feature) AS most, sum(h) OVER (PARTITION BY feature ORDER BY x) AS hl,
    {", ".join(f"sum(g{k}) OVER (PARTITION BY feature ORDER BY x) AS gl{k}" for k in range(4))} FROM cells),
  cuts AS (SELECT DISTINCT place, feature, x AS threshold, hl, gl0, gl1, gl2, gl3 FROM ranked, range(1, 256) s(i)
      WHERE x < most AND upto >= ceil(i / 256.0 * total) AND upto - n < ceil(i / 256.0 * total)
    UNION ALL SELECT place, feature, 0.5, t.h - c.h, t.g0 - c.g0, t.g1 - c.g1, t.g2 - c.g2, t.g3 - c.g3 FROM whole t, (
      {" UNION ALL ".join(
          f"SELECT {10 + i} AS place, concat('{c}_', coalesce(cast({c} AS varchar), 'nan')) AS feature, sum(h) AS h, "
          + ", ".join(f"sum(g{k}) AS g{k}" for k in range(4)) + f" FROM graded GROUP BY {c}"
          for i, c in enumerate(CATEGORICAL_FEATURES))}) c),
  sides AS (SELECT k, place, feature, threshold, c.hl AS hl, t.h - c.hl AS hr, t.h AS h,
      CASE k WHEN 0 THEN gl0 WHEN 1 THEN gl1 WHEN 2 THEN gl2 ELSE gl3 END AS gl,
      CASE k WHEN 0 THEN t.g0 WHEN 1 THEN t.g1 WHEN 2 THEN t.g2 ELSE t.g3 END AS g
    FROM cuts c, whole t, range(4) s(k)),
  gains AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (hr + 1) - g * g / (h + 1) AS gain FROM sides
    WHERE hl >= 1 AND hr >= 1)
  --- SELECT cast(k AS int) AS class, feature, threshold, round(gain, 3) AS gain FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, place, feature, threshold) AS r FROM gains) WHERE r = 1"""


@query("m5_first_splits", _FIRST_SPLITS)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The feature and threshold on which the first tree of each class splits, over unscaled features."""
    # narrow tables written once: means, codes, weights and bins each read them again
    cleaned = stored(with_targets(clean_for_model(flights(spark, sf), "drop", [])), "cleaned")
    rows = stored(build_features(cleaned, fit_on="all"), "features")
    hot = models.encoder().fit(rows).transform(spread(rows))
    vectors = VectorAssembler(
        inputCols=[*NUMERIC_FEATURES, *[f"{c}_hot" for c in CATEGORICAL_FEATURES]], outputCol=models.FEATURES).transform(hot)
    train = with_balanced_weight(vectors, models.LABEL)
    names, stump = models.feature_names(vectors), boosting.Setting(1, 1.0)
    fitted = boosting.boost(stored(train.select(models.FEATURES, models.LABEL, models.WEIGHT), "vectors"), [stump], 1,
                            models.FEATURES, models.LABEL, models.WEIGHT, 4)
    roots = [(c, *fitted.bins.split(int(tree.cell[0])), float(tree.gain[0])) for c, tree in enumerate(fitted.rounds[stump][0])]
    return spark.createDataFrame([(c, names[place], threshold, round(gain, 3)) for c, place, threshold, gain in roots],
                                 "class int, feature string, threshold double, gain double")


@query("m7_tune_logistic")
def tune_logistic(spark, sf):
    p = prepared(spark, sf)
    return models.grid_fit(models.fit_logistic_by, models.LOGISTIC_GRID, p.train, p.test).results


def boosted_grid(spark: SparkSession, sf: str) -> models.Tuned:
    p = prepared(spark, sf)
    return models.boosted_grid_fit(p.train, p.test)


@query("m8_tune_boosted")
def tune_boosted(spark, sf):
    return once(spark, sf, boosted_grid).results


# Test rows of each class: ceil(0.2 n) shared out by largest remainder, as the split does.
_TEST_CLASSES = _FEATURES_BASE + f""",
  levels AS (SELECT {_level('total_delay')} AS delay_level, cast(count(*) AS hugeint) AS n FROM base GROUP BY 1),
  wanted AS (SELECT *, cast(ceil(0.2 * sum(n) OVER ()) AS hugeint) AS wanted, cast(sum(n) OVER () AS hugeint) AS total FROM levels),
  shared AS (SELECT *, (n * wanted) // total AS own, (n * wanted) % total AS rest FROM wanted),
  quotas AS (SELECT delay_level, cast(own + CASE WHEN row_number() OVER (ORDER BY rest DESC, delay_level)
    <= wanted - sum(own) OVER () THEN 1 ELSE 0 END AS bigint) AS quota FROM shared)"""


@query("m8_grid_rows", _TEST_CLASSES + """--- SELECT cast(row_number() OVER (ORDER BY learning_rate, max_depth, n_estimators) - 1 AS int) AS config,
    learning_rate, max_depth, n_estimators, true AS fitted, true AS figures_fit, """ + ", ".join(
    f"(SELECT quota FROM quotas WHERE delay_level = {c}) AS support_{c}" for c in range(4)) + """
  FROM (VALUES (cast(0.05 AS double)), (0.1)) r(learning_rate), (VALUES (3), (6), (9)) d(max_depth), (VALUES (100), (200), (300)) e(n_estimators)""")
def _(spark, sf):
    """Which configurations there are, that all could be fitted, and that their figures are shares of the test rows."""
    results = once(spark, sf, boosted_grid).results
    right = sum((F.col(f"recall_{c}") * F.col(f"support_{c}") for c in CLASSES), F.lit(0.0)) / F.col("support")
    return results.select(
        "config", "learning_rate", "max_depth", "n_estimators", F.col("error").isNull().alias("fitted"),
        (F.abs(right - F.col("accuracy")) < 1e-9).alias("figures_fit"), *[f"support_{c}" for c in CLASSES])


@query("m9_select_refit", _FEATURES_BASE + """,
  parts AS (SELECT count(*) AS n, cast(ceil(count(*) * 0.2) AS bigint) AS test, cast(ceil(count(*) * 0.36) AS bigint) AS held FROM base)
  --- SELECT cast(10 AS bigint) AS configs, cast(0 AS bigint) AS failed, true AS best_chosen, n - held AS train, held - test AS validation, test,
  cast(0 AS bigint) AS different FROM parts""")
def _(spark, sf):
    """Sizes of the three parts, and that the best configuration was refitted and saved and scores alike when loaded."""
    path = scratch_path(spark, "selected")
    chosen = models.select_and_refit(flights(spark, sf), KEY, models.fit_logistic_by, models.LOGISTIC_GRID, path)
    results = chosen.results.selectExpr(
        "count(*) AS configs", "count(error) AS failed",
        f"min(struct(-recall_3, config)).config = {chosen.config} AS best_chosen")
    parts = chosen.rows.agg(*[F.count_if(F.col("split") == p).alias(p) for p in ("train", "validation", "test")])
    scored = (scoring.score(m, chosen.test_rows) for m in (chosen.model, scoring.load_model(path)))
    return results.crossJoin(parts).crossJoin(_differences(*scored).select("different"))


@query("m11_importances")
def _(spark, sf):
    p, model = once(spark, sf, boosted)
    return models.importances(model, p.train)


def saved(spark: SparkSession, sf: str) -> tuple[models.Prepared, dict[str, tuple[str, str]]]:
    """Three models, saved; the last one is the only one that was fitted before."""
    p, trees = once(spark, sf, boosted)
    folder = scratch_path(spark, "models")
    fitted = {
        "Linear Regression": (models.fit_linear(p.train), scoring.REGRESSION),
        "Logistic Regression": (models.fit_logistic(p.train), scoring.CLASSIFICATION),
        "Boosted Trees": (trees, scoring.CLASSIFICATION),
    }
    paths = {}
    for name, (model, kind) in fitted.items():
        paths[name] = (f"{folder}/{name.replace(' ', '-')}", kind)
        scoring.save_model(p.whole(model), paths[name][0])
    return p, paths


@query("m14_compare_models")
def _(spark, sf):
    p, paths = once(spark, sf, saved)
    return scoring.compare_models(paths, p.test_rows)


@query("m14_confusions")
def _(spark, sf):
    p, paths = once(spark, sf, saved)
    return scoring.confusions(paths, p.test_rows)


# Rows of the split's test part, by the quotas of the stratified split.
_TEST_SIZE = _FEATURES_BASE + """--- SELECT cast(ceil(count(*) * 0.2) AS bigint) AS n,
  cast(0 AS bigint) AS different FROM base"""


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a``, and how many have another class or probability in ``b``."""
    theirs = b.select(KEY, F.col("class").alias("_class"), F.col("prob").alias("_prob"))
    same = F.col("class").eqNullSafe(F.col("_class")) & F.col("prob").eqNullSafe(F.col("_prob"))
    return a.join(theirs, KEY, "left").agg(
        F.count("*").alias("n"), F.count_if(~same).alias("different"))


@query("s12_save_and_load", _TEST_SIZE)
def _(spark, sf):
    p = prepared(spark, sf)
    model, path = p.whole(models.fit_ovr_logistic(p.train)), scratch_path(spark, "model")
    scoring.save_model(model, path)
    return _differences(scoring.score(model, p.test_rows), scoring.score(scoring.load_model(path), p.test_rows))


@query("m15_score")
def score(spark, sf):
    p = prepared(spark, sf)
    scored = scoring.score(p.whole(models.fit_logistic(p.train)), p.rows)
    return scoring.with_text(scored).select(KEY, "class", "prob", "class_text", "percent")


@query("m15_score_requests")
def score_requests(spark, sf):
    df = flights(spark, sf)
    fitted = service.fit_service(_with_total(df))
    return service.score_requests(fitted, service.requests(df), [KEY])


_ALL_ROWS = _FEATURES_BASE + "--- SELECT count(*) AS n, cast(0 AS bigint) AS different FROM base"


@query("m16_score_stream", _ALL_ROWS)
def scored_stream(spark, sf):
    p = prepared(spark, sf)
    model = p.whole(models.fit_ovr_logistic(p.train))
    src, dst, state = (scratch_path(spark, n) for n in ("requests", "scores", "progress"))
    p.rows.write.parquet(src)
    stream = spark.readStream.schema(p.rows.schema).parquet(src)
    write_scores(score_stream(model, stream), dst, state).awaitTermination()
    return _differences(scoring.score(model, p.rows), spark.read.parquet(dst))


@query("m18_expected_delay")
def _(spark, sf):
    p = prepared(spark, sf)
    whole: PipelineModel = p.whole(models.fit_linear(p.train))
    return scoring.expected_delay(whole, p.rows).select(KEY, "minutes", "class")
