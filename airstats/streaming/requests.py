"""Requests that arrive as a stream, joined with the newest encodings and route counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from airstats.operators.features import SERVING_FEATURES, serving_features
from airstats.plans.scoring import score, with_text
from airstats.plans.service import requests
from airstats.sources.parquet import has_files, subfolders

#: Folder of a version that is written last: a version without a finished one is not read.
_LAST = "routes"


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Finished versions of the maps in a folder."""
    folders = {int(f.rpartition("=")[2]): f for f in subfolders(spark, path) if "/version=" in f}
    return {n: f for n, f in folders.items() if has_files(spark, f"{f}/{_LAST}", "_SUCCESS")}


def save_maps(maps: Mapping[str, DataFrame], totals: DataFrame, path: str) -> int:
    """Write encodings (column -> table) and flights per route as a new version; returns its number."""
    spark = totals.sparkSession
    taken = [int(f.rpartition("=")[2]) for f in subfolders(spark, path) if "/version=" in f]
    version = max(taken, default=0) + 1
    for column, mapping in maps.items():
        mapping.write.parquet(f"{path}/version={version}/maps/{column}")
    totals.write.parquet(f"{path}/version={version}/{_LAST}")
    return version


def load_maps(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Encodings and flights per route of the newest finished version."""
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"no finished maps in {path}")
    newest = versions[max(versions)]
    maps = {f.rpartition("/")[2]: spark.read.parquet(f) for f in subfolders(spark, f"{newest}/maps")}
    return maps, spark.read.parquet(f"{newest}/{_LAST}")


def write_requests(stream: DataFrame, maps: str, dst: str, checkpoint: str, keep: Sequence[str] = (),
                   model: Transformer | None = None) -> StreamingQuery:
    """Encode, and with a ``model`` score, the flights that are there, and stop.

    Every micro-batch reads the newest maps, so a new version takes effect without a restart, and is
    joined with them as tables of known size: broadcast when small, shuffled otherwise. It writes a
    partition ``batch`` of its own; a batch that is repeated replaces it. Codes without an encoding take
    the mean of all codes, routes without flights count 0, nulls likewise.
    """
    def write(batch: DataFrame, number: int) -> None:
        encodings, totals = load_maps(batch.sparkSession, maps)
        rows = serving_features(requests(batch, totals), encodings, keep)
        if model is not None:
            rows = with_text(score(model, rows)).drop(*SERVING_FEATURES)
        rows.write.mode("overwrite").parquet(f"{dst}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
