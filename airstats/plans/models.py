"""Fitting, tuning and reading of the delay models with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product
from typing import NamedTuple

from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from airstats.functions import key_text
from airstats.operators.evaluate import class_metrics, select_best
from airstats.operators.features import (
    CATEGORICAL_FEATURES, NUMERIC_FEATURES, TEST, TRAIN, VALIDATION, build_features, standard_stats, with_targets,
)
from airstats.operators.filters import clean_for_model
from airstats.operators.split import CLASSES, stratified_split, with_balanced_weight
from airstats.plans.boosting import LOCAL_ROWS, BoostedModel, Setting, boost
from airstats.plans.linear import LinearModel, OneVsRestModel, fit_least_squares, fit_one_vs_rest
from airstats.plans.scoring import save_model, score
from airstats.storage import spread, stored

# Settings and grids of the models; a grid's last parameter varies fastest.
LOGISTIC_ITERATIONS = 2000
TUNING_ITERATIONS = 5000
BOOSTED = {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.05}
LOGISTIC_GRID = {"C": (0.01, 0.1, 1, 10, 100), "solver": ("lbfgs", "liblinear")}
BOOSTED_GRID = {"learning_rate": (0.05, 0.1), "max_depth": (3, 6, 9), "n_estimators": (100, 200, 300)}
MODEL_SEED = 42
IMPORTANCES = 10
VALIDATION_SHARE = 0.16  # a fifth of what the test part leaves

JOINT_KEY = "flight_key"
LABEL, TARGET, FEATURES, WEIGHT = "delay_level", "total_delay", "features", "weight"


# Preparation.

def scaler(train: DataFrame, cols: Sequence[str] = NUMERIC_FEATURES) -> SQLTransformer:
    """(x - mean) / population deviation as SQL, the fitted numbers written into it.

    Spark's own StandardScaler divides by the sample deviation.
    """
    stats = standard_stats(train, cols).head().stats
    scaled = [f"(`{c}` - ({stats[c]['mean']!r}D)) / {stats[c]['std']!r}D AS `{c}_z`" for c in cols]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def encoder(cats: Sequence[str] = CATEGORICAL_FEATURES) -> Pipeline:
    """One 0/1 column per category; a category not seen in training has none set.

    A missing value is a category of its own, the text ``nan``.
    """
    texts = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(cast(`{c}` AS string), 'nan') AS `{c}_text`" for c in cats) + " FROM __THIS__")
    index = StringIndexer(
        inputCols=[f"{c}_text" for c in cats], outputCols=[f"{c}_index" for c in cats],
        handleInvalid="keep", stringOrderType="alphabetAsc")
    # The one dropped is the place StringIndexer keeps for unseen values.
    one_hot = OneHotEncoder(
        inputCols=[f"{c}_index" for c in cats], outputCols=[f"{c}_hot" for c in cats], dropLast=True)
    return Pipeline(stages=[texts, index, one_hot])


def assembler(nums: Sequence[str] = NUMERIC_FEATURES, cats: Sequence[str] = CATEGORICAL_FEATURES,
              handle_invalid: str = "error") -> VectorAssembler:
    """Scaled numbers first, then the 0/1 columns."""
    return VectorAssembler(
        inputCols=[f"{c}_z" for c in nums] + [f"{c}_hot" for c in cats], outputCol=FEATURES,
        handleInvalid=handle_invalid)


def fit_preprocessing(train: DataFrame, nums: Sequence[str] = NUMERIC_FEATURES,
                      cats: Sequence[str] = CATEGORICAL_FEATURES,
                      on_null_number: str = "error") -> PipelineModel:
    """Everything between the feature table and the vector, fitted on training rows.

    ``on_null_number``: "error" refuses null numbers, "skip" drops their rows, "impute" puts the
    training mean in their place (0 once scaled).
    """
    stages: list[Transformer] = [scaler(train, nums)]
    if on_null_number == "impute":
        stages.append(SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(f"`{c}_z`" for c in nums)
                                     + "), " + ", ".join(f"coalesce(`{c}_z`, 0D) AS `{c}_z`" for c in nums)
                                     + " FROM __THIS__"))
    encoded = encoder(cats).fit(train)
    vector = assembler(nums, cats, "error" if on_null_number == "impute" else on_null_number)
    return PipelineModel([*stages, *encoded.stages, vector])


class Prepared:
    """Training, validation and test rows as written vector tables, with the preprocessing fitted on training rows.

    Every later fit reads the written vectors: neither features nor vectors are computed twice,
    and a lost executor costs a re-read.
    """

    def __init__(self, features: DataFrame, split: str = "split", keep: Sequence[str] = (),
                 on_null_number: str = "impute"):
        rows = stored(features, "features")
        train = rows.where(F.col(split) == TRAIN)
        self.rows = rows
        self.test_rows = rows.where(F.col(split) == TEST)
        self.preprocessing = fit_preprocessing(train, on_null_number=on_null_number)
        vectors = self.preprocessing.transform(spread(rows)).select(*keep, split, LABEL, TARGET, FEATURES)
        vectors = stored(with_balanced_weight(vectors, LABEL, fit_on=train), "vectors")
        self.train = vectors.where(F.col(split) == TRAIN).drop(split)
        self.test = vectors.where(F.col(split) == TEST).drop(split)
        self.validation = vectors.where(F.col(split) == VALIDATION).drop(split)

    def whole(self, model: Transformer) -> PipelineModel:
        """Preprocessing and model as one, ready to be saved and to score feature tables."""
        return PipelineModel([*self.preprocessing.stages, *stages(model)])


def prepare(df: DataFrame, key: str | Sequence[str], fit_on: str = "train",
            on_null_number: str = "impute", on_null_delay: str = "drop") -> Prepared:
    """Clean flights to split, encoded rows. A key of several columns becomes one, ``flight_key``.

    ``fit_on="all"`` computes route means and frequent airports before the split, from test rows
    too; ``"train"`` does not let the test rows leak into the features. ``on_null_delay="zero"``
    counts an unknown delay as none instead of leaving the row out.
    """
    rows, key = divided(df, key, on_null_delay)
    return encoded(rows, key, fit_on, on_null_number)


def divided(df: DataFrame, key: str | Sequence[str], on_null_delay: str = "drop",
            validation: float = 0.0) -> tuple[DataFrame, str]:
    """Cleaned flights with ``split``, and the name of their key."""
    if not isinstance(key, str):
        df, key = df.withColumn(JOINT_KEY, key_text(key)), JOINT_KEY
    # The narrow cleaned rows are read four more times: written once, however they came about.
    cleaned = stored(with_targets(clean_for_model(df, on_null_delay, [key])), "cleaned")
    return stratified_split(cleaned, LABEL, key, validation=validation), key


def encoded(rows: DataFrame, key: str, fit_on: str = "train", on_null_number: str = "impute") -> Prepared:
    """Divided rows with features and vectors, everything learnt from the training rows."""
    features = build_features(rows, [key], fit_on=fit_on, split_col="split")
    return Prepared(features, keep=[key], on_null_number=on_null_number)


# Models.

def stages(model: Transformer) -> list[Transformer]:
    return list(model.stages) if isinstance(model, PipelineModel) else [model]


def fit_linear(train: DataFrame) -> LinearModel:
    """Least squares without penalty on minutes of total delay."""
    return fit_least_squares(train, FEATURES, TARGET, "minutes")


def _penalty(train: DataFrame, C: float, weight: str) -> float:
    """Spark averages the loss over the weights, C is meant for their sum."""
    return 1.0 / (C * train.agg(F.sum(weight)).head()[0])


def fit_logistic(train: DataFrame, C: float = 1.0, max_iter: int = LOGISTIC_ITERATIONS) -> Model:
    """Multinomial logistic regression with balanced weights."""
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, family="multinomial",
        standardization=False, regParam=_penalty(train, C, WEIGHT), maxIter=max_iter).fit(train)


def fit_ovr_logistic(train: DataFrame, C: float = 1.0, max_iter: int = TUNING_ITERATIONS) -> OneVsRestModel:
    """One-vs-rest logistic regression; each binary problem is balanced by itself, its constant penalised."""
    return fit_one_vs_rest(train, FEATURES, LABEL, CLASSES, C, max_iter)


def fit_boosted(train: DataFrame, n_estimators: int = BOOSTED["n_estimators"],
                max_depth: int = BOOSTED["max_depth"],
                learning_rate: float = BOOSTED["learning_rate"], local_rows: int = LOCAL_ROWS) -> BoostedModel:
    """Boosted trees on the joint softmax loss of all classes, with balanced weights."""
    setting = Setting(max_depth, learning_rate)
    fitted = boost(train, [setting], n_estimators, FEATURES, LABEL, WEIGHT, len(CLASSES), local_rows)
    return fitted.model(setting, features=FEATURES)


# Tuning.

def param_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, names in order, the last one varying fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]


def fit_logistic_by(train: DataFrame, C: float, solver: str) -> Model:
    """``lbfgs`` is one multinomial model, ``liblinear`` one model per class."""
    if solver == "liblinear":
        return fit_ovr_logistic(train, C)
    if solver == "lbfgs":
        return fit_logistic(train, C, TUNING_ITERATIONS)
    raise ValueError(f"unknown solver: {solver}")


class Tuned:
    """``results``: a row per configuration; ``model``: the best one, None if all failed."""

    def __init__(self, results: DataFrame, models: Mapping[int, Transformer]):
        self.results = results
        self.models = models

    @property
    def model(self) -> Transformer | None:
        best = select_best(self.results).select("config").head()
        return None if best is None else self.models[best.config]


def _measured(config: int, params: Mapping, fitted: Callable[[], Model], test: DataFrame) -> tuple[DataFrame, Model | None]:
    """A configuration's row of results, and its model if it could be had."""
    labels = [F.lit(v).alias(k) for k, v in params.items()]
    try:
        model = fitted()
        metrics = class_metrics(score(model, test), LABEL, "class")
        row = metrics.select(F.lit(config).alias("config"), *labels, *metrics.columns,
                             F.lit(None).cast("string").alias("error"))
        return stored(row, "configuration"), model
    except Exception as e:  # any failure of a fit or a score is reported, the search goes on
        return test.sparkSession.range(1).select(
            F.lit(config).alias("config"), *labels, F.lit(str(e)).alias("error")), None


def _tuned(measured: Sequence[tuple[DataFrame, Model | None]]) -> Tuned:
    results = measured[0][0]
    for row, _ in measured[1:]:
        results = results.unionByName(row, allowMissingColumns=True)
    return Tuned(stored(results, "grid"), {i: m for i, (_, m) in enumerate(measured) if m is not None})


def grid_fit(fit: Callable[..., Model], grid: Mapping[str, Sequence], train: DataFrame,
             test: DataFrame) -> Tuned:
    """Fit every configuration on the same vectors and measure it on ``test``.

    ``test`` may be a validation part, or the test rows themselves for figures comparable with
    published ones. A configuration that fails gets a row with its error and no figures.
    """
    return _tuned([_measured(i, params, lambda params=params: fit(train, **params), test)
                   for i, params in enumerate(param_grid(grid))])


def boosted_grid_fit(train: DataFrame, test: DataFrame, grid: Mapping[str, Sequence] = BOOSTED_GRID) -> Tuned:
    """As ``grid_fit`` for boosted trees, in one boosting run.

    Configurations that differ in the number of trees only are prefixes of one model, and all depths
    and learning rates are boosted side by side over the same bins, a job for the trees of a round.
    """
    setting = lambda p: Setting(p["max_depth"], p["learning_rate"])
    configs = param_grid(grid)
    settings = sorted({setting(p) for p in configs})
    fitted = boost(train, settings, max(grid["n_estimators"]), FEATURES, LABEL, WEIGHT, len(CLASSES))
    return _tuned([
        _measured(i, p, lambda p=p: fitted.model(setting(p), p["n_estimators"], FEATURES), test)
        for i, p in enumerate(configs)])


class Selected(NamedTuple):
    """Results of all configurations on the validation part, the best one's number and parameters, and its
    model fitted anew on training and validation rows, with the rows that it was not shown."""

    results: DataFrame
    config: int
    params: dict
    model: PipelineModel
    rows: DataFrame
    test_rows: DataFrame


def select_and_refit(df: DataFrame, key: str | Sequence[str], fit: Callable[..., Model], grid: Mapping[str, Sequence],
                     path: str, validation: float = VALIDATION_SHARE) -> Selected:
    """Tune on a validation part, fit the best configuration anew on training and validation rows, and save
    it with its preprocessing at ``path``.

    No choice sees the test rows. Preprocessing is learnt from training rows for the search, and
    from training and validation rows for the model that is kept.
    """
    rows, key = divided(df, key, validation=validation)
    rows = stored(rows, "divided")
    search = encoded(rows, key)
    tuned = grid_fit(fit, grid, search.train, search.validation)
    best = select_best(tuned.results).select("config").head()
    if best is None:
        raise ValueError("no configuration could be fitted")
    params = param_grid(grid)[best.config]
    learnt = F.when(F.col("split") == TEST, TEST).otherwise(TRAIN)
    final = encoded(rows.withColumn("split", learnt), key)
    model = final.whole(fit(final.train, **params))
    save_model(model, path)
    return Selected(tuned.results, best.config, params, model, rows, final.test_rows)


# Reading models.

def feature_names(vectors: DataFrame) -> list[str]:
    """Names of the vector's places, from its metadata: ``route_risk``, ``op_carrier_AA``."""
    groups = vectors.schema[FEATURES].metadata["ml_attr"]["attrs"]
    places = sorted((a["idx"], a["name"]) for group in groups.values() for a in group)
    return [name.removesuffix("_z").replace("_hot_", "_", 1) for _, name in places]


def importances(model: Transformer, vectors: DataFrame, k: int = IMPORTANCES) -> DataFrame:
    """The ``k`` features that weigh most, by the mean gain of their splits."""
    mean = next(m.featureImportances for m in stages(model) if hasattr(m, "featureImportances"))
    spark = vectors.sparkSession
    table = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(feature_names(vectors), mean)], "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)
