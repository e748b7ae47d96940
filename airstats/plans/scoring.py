"""Scores, comparison of saved models, expected delay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from airstats.functions import argmax, class_text, delay_level, winning_percent
from airstats.operators.evaluate import class_metrics, confusion, regression_report

REGRESSION, CLASSIFICATION = "regression", "classification"


def score(model: Transformer, df: DataFrame) -> DataFrame:
    """``df`` with ``class`` and ``prob``, the list of class probabilities. Works on streams too."""
    scored = model.transform(df).withColumn("prob", vector_to_array("probability"))
    return scored.select(*df.columns, argmax("prob").alias("class"), "prob")


def with_text(scored: DataFrame) -> DataFrame:
    """What a traveller is shown: the class in words and the percent of the winning class."""
    return scored.withColumns({"class_text": class_text("class"), "percent": winning_percent("prob")})


def expected_delay(model: Transformer, df: DataFrame) -> DataFrame:
    """``df`` with the minutes of delay a linear model expects and the level they fall in."""
    minutes = model.transform(df)
    return minutes.select(*df.columns, "minutes", delay_level("minutes").alias("class"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(f"{path}/metadata").head()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def predictions_of(model: Transformer, kind: str, test: DataFrame) -> DataFrame:
    return expected_delay(model, test) if kind == REGRESSION else score(model, test)


def compare_models(models: Mapping[str, tuple[str, str]], test: DataFrame, label: str = "delay_level",
                   target: str = "total_delay") -> DataFrame:
    """Saved models, name -> (path, kind), on the same test rows: a row each, absent ones left out."""
    spark = test.sparkSession
    rows = []
    for name, (path, kind) in models.items():
        if not _exists(spark, path):
            continue
        predicted = predictions_of(load_model(path), kind, test)
        row = class_metrics(predicted, label, "class").withColumn("model", F.lit(name))
        if kind == REGRESSION:
            fit = regression_report(predicted, target, "minutes").agg(
                F.struct(F.first("rmse").alias("rmse"), F.first("r2").alias("r2"))).scalar()
            row = row.withColumns({"rmse": fit["rmse"], "r2": fit["r2"]})
        rows.append(row)
    if not rows:
        raise ValueError("none of the models exists")
    table = rows[0]
    for row in rows[1:]:
        table = table.unionByName(row, allowMissingColumns=True)
    return table


def confusions(models: Mapping[str, tuple[str, str]], test: DataFrame,
               label: str = "delay_level") -> DataFrame:
    """Confusion matrices of saved models, one below the other."""
    table = None
    for name, (path, kind) in models.items():
        if _exists(test.sparkSession, path):
            predicted = predictions_of(load_model(path), kind, test)
            part = confusion(predicted, label, "class").withColumn("model", F.lit(name))
            table = part if table is None else table.unionByName(part)
    if table is None:
        raise ValueError("none of the models exists")
    return table
