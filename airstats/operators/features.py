"""Features of the delay models and of the scoring service."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from airstats.functions import (
    code_text, delay_level, dep_hour, hash52, is_weekend, key_text, season, time_of_day, to_number,
)
from airstats.functions.parse import DEFAULT_HOUR
from airstats.operators.filters import clean_for_model
from airstats.operators.rank import OTHER, TOP_AIRPORTS, as_list, keep_or_other
from airstats.storage import stored

# Model features in assembly order, and the scoring service's in its order.
NUMERIC_FEATURES = ("crs_elapsed_time", "route_risk", "o_prcp", "o_wspd", "d_prcp", "d_wspd")
CATEGORICAL_FEATURES = (
    "op_carrier", "origin_grouped", "dest_grouped", "dep_hour", "month", "season", "is_weekend")
ENCODED_COLUMNS = ("op_carrier", "origin", "dest")
SERVING_FEATURES = (
    "MONTH", "DAY_OF_WEEK", "HOUR", "TIME_OF_DAY", "ROUTE_COUNT", "CRS_ELAPSED_TIME",
    "TE_OP_CARRIER", "TE_ORIGIN", "TE_DEST",
)
FOLDS, FOLD_SEED = 5, 7
TRAIN, TEST, VALIDATION = "train", "test", "validation"


def _number(df: DataFrame, col: str) -> Column:
    """A column as double, 0 where it has no number. Only text has to be read."""
    if isinstance(df.select(col).schema[0].dataType, T.NumericType):
        return F.coalesce(F.nanvl(F.col(col).cast("double"), F.lit(None)), F.lit(0.0))
    return to_number(col)


def with_targets(df: DataFrame) -> DataFrame:
    """TOTAL_DELAY and DELAY_LEVEL; an unreadable delay counts as 0."""
    total = _number(df, "arr_delay") + _number(df, "dep_delay")
    return df.withColumn("total_delay", total).withColumn("delay_level", delay_level("total_delay"))


def with_time_features(df: DataFrame, time_format: str = "datetime") -> DataFrame:
    """DEP_HOUR, IS_WEEKEND and SEASON; ``time_format`` as in ``dep_hour``."""
    return df.withColumns({
        "dep_hour": dep_hour("crs_dep_time", time_format, DEFAULT_HOUR),
        "is_weekend": is_weekend("day_of_week"),
        "season": season("month"),
    })


def route_totals(df: DataFrame, value: str = "total_delay", origin: str = "origin",
                 dest: str = "dest") -> DataFrame:
    """Flights and summed delay per route, null ends included, as a written table.

    One narrow scan of the flights; route means, the global mean, flights per route and the most
    frequent airports are all read off this table.
    """
    totals = df.groupBy(origin, dest).agg(F.count(value).alias("known"), F.sum(value).alias("delay"),
                                          F.count("*").alias("flights"))
    return stored(totals, "routes")


def _route_means(totals: DataFrame, origin: str, dest: str) -> DataFrame:
    """Mean per route. A route with a null end has none: it takes the global mean."""
    return totals.where(
        F.col(origin).isNotNull() & F.col(dest).isNotNull() & (F.col("known") > 0)
    ).select(origin, dest, (F.col("delay") / F.col("known")).alias("_route_mean"))


def _global_mean(totals: DataFrame) -> Column:
    return totals.agg(
        (F.sum("delay") / F.nullif(F.sum("known"), F.lit(0))).alias("mean")).scalar()


def with_route_risk(df: DataFrame, totals: DataFrame, origin: str = "origin",
                    dest: str = "dest") -> DataFrame:
    """Mean delay of each row's route, the global mean where the route is unknown."""
    joined = df.join(_route_means(totals, origin, dest), [origin, dest], "left")
    return joined.withColumn(
        "route_risk", F.coalesce(F.col("_route_mean"), _global_mean(totals))).drop("_route_mean")


def _fitted_on(df: DataFrame, fit_on: str, split_col: str | None) -> DataFrame:
    if fit_on == "all":
        return df
    if fit_on == "train" and split_col:
        return df.where(F.col(split_col) == TRAIN)
    raise ValueError("fit_on is 'all', or 'train' together with split_col")


def route_risk(df: DataFrame, fit_on: str = "train", split_col: str | None = None,
               value: str = "total_delay") -> DataFrame:
    """ROUTE_RISK. ``fit_on="all"`` also lets test rows into the means, ``"train"`` does not."""
    return with_route_risk(df, route_totals(_fitted_on(df, fit_on, split_col), value))


def out_of_fold_sums(df: DataFrame, by: Sequence[str], value: str, key: str | Sequence[str], folds: int = FOLDS,
                     seed: int = FOLD_SEED) -> DataFrame:
    """Count and sum of ``value`` per category, in all and in each fold, as a written table.

    One aggregate of 2 * ``folds`` + 2 figures, so the rows are shuffled once, as partial sums. Null
    categories have a row too: they count for the mean of all.
    """
    fold = _fold(key, folds, seed)
    parts = [F.when(fold == f, F.col(value)) for f in range(folds)]
    return stored(df.groupBy(*by).agg(
        F.count(value).alias("known"), F.sum(value).cast("double").alias("total"),
        F.array(*[F.count(p) for p in parts]).alias("fold_known"),
        F.array(*[F.coalesce(F.sum(p).cast("double"), F.lit(0.0)) for p in parts]).alias("fold_total")), "folds")


def _fold(key: str | Sequence[str], folds: int, seed: int) -> Column:
    return (hash52(key_text(key), seed) % folds).cast("int")


def with_out_of_fold_mean(df: DataFrame, sums: DataFrame, by: Sequence[str], name: str, key: str | Sequence[str],
                          folds: int = FOLDS, seed: int = FOLD_SEED, learnt: Column | None = None) -> DataFrame:
    """Mean of the category's rows in the other folds, so no row's own value is in its feature.

    ``sums`` is :func:`out_of_fold_sums` of the rows for which ``learnt`` holds (all by default); other
    rows take the mean of all folds. A category that has nothing in the folds that count, or is null or
    unseen, takes the mean of all categories over those folds. Null if there is no value at all.
    """
    learnt = F.lit(True) if learnt is None else F.coalesce(learnt, F.lit(False))
    arrays = [F.sum(F.col("fold_known")[f]).alias(f"k{f}") for f in range(folds)] + [
        F.sum(F.col("fold_total")[f]).alias(f"t{f}") for f in range(folds)]
    one = sums.agg(F.sum("known").alias("known"), F.sum("total").alias("total"), *arrays)
    whole = one.select(F.struct(
        "known", "total", F.array(*[f"k{f}" for f in range(folds)]).alias("fold_known"),
        F.array(*[f"t{f}" for f in range(folds)]).alias("fold_total")).alias("whole")).scalar()
    fold = _fold(key, folds, seed)

    def others(known: Column, total: Column, fold_known: Column, fold_total: Column) -> Column:
        left = known - F.when(learnt, fold_known[fold]).otherwise(0)
        return F.when(left > 0, (total - F.when(learnt, fold_total[fold]).otherwise(0.0)) / left)

    columns = ("known", "total", "fold_known", "fold_total")
    found = sums.select(*by, F.struct(*columns).alias("_sums"))
    mean = F.coalesce(others(*[F.col("_sums")[c] for c in columns]), others(*[whole[c] for c in columns]))
    return df.join(found, list(by), "left").withColumn(name, mean).drop("_sums")


def with_grouped_ends(df: DataFrame, totals: DataFrame, k: int = TOP_AIRPORTS) -> DataFrame:
    """ORIGIN_GROUPED and DEST_GROUPED: the k most frequent of each, the rest OTHER."""
    def grouped(col: str) -> Column:
        top = (
            totals.groupBy(code_text(col).alias("value")).agg(F.sum("flights").alias("n"))
            .orderBy(F.desc("n"), "value").limit(k)
        )
        return keep_or_other(code_text(col), as_list(top))

    return df.withColumns({"origin_grouped": grouped("origin"), "dest_grouped": grouped("dest")})


def build_features(df: DataFrame, keep: Sequence[str] = (), on_null_delay: str = "drop",
                   fit_on: str = "train", split_col: str | None = None,
                   k: int = TOP_AIRPORTS, time_format: str = "datetime") -> DataFrame:
    """Clean rows with both targets and all features; raw delay, time and airport columns dropped.

    ``keep`` names further columns to carry along, such as the flight's key. With
    ``fit_on="train"`` route means and most frequent airports come from training rows only.
    """
    carried = list(dict.fromkeys([*keep, *([split_col] if split_col else [])]))
    rows = with_time_features(with_targets(clean_for_model(df, on_null_delay, carried)), time_format)
    totals = route_totals(_fitted_on(rows, fit_on, split_col))
    full = with_grouped_ends(with_route_risk(rows, totals), totals, k)
    return full.drop("arr_delay", "dep_delay", "crs_dep_time", "origin", "dest")


def standard_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with mean and population standard deviation of each column, 0 replaced by 1."""
    def scale(c: str) -> Column:
        s = F.stddev_pop(c)
        return F.when(s == 0, 1.0).otherwise(s)

    return df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), scale(c).alias("std")).alias(c) for c in cols]).alias("stats"))


def standardise(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation. ``stats`` may come from other rows."""
    fitted = (standard_stats(df, cols) if stats is None else stats).scalar()
    return df.withColumns({c: (F.col(c) - fitted[c]["mean"]) / fitted[c]["std"] for c in cols})


def target_encoding(df: DataFrame, col: str, target: str) -> DataFrame:
    """Mean target per category as (col, te_col), a written table."""
    means = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.avg(target).alias(f"te_{col}"))
    return stored(means, f"te-{col}")


def target_encodings(df: DataFrame, cols: Sequence[str], target: str) -> dict[str, DataFrame]:
    """As ``target_encoding`` for several columns: one pass over the rows, each table rolled up from it."""
    sums = stored(df.groupBy(*cols).agg(F.sum(target).alias("_sum"), F.count(target).alias("_known")), "te-sums")
    mean = F.sum("_sum") / F.nullif(F.sum("_known"), F.lit(0))
    return {c: stored(sums.where(F.col(c).isNotNull()).groupBy(c).agg(mean.alias(f"te_{c}")), f"te-{c}")
            for c in cols}


def apply_encoding(df: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """Look a category up; an unseen one takes the unweighted mean of all categories."""
    te = f"te_{col}"
    default = mapping.agg(F.avg(te)).scalar()
    looked_up = mapping.select(F.col(col), F.col(te).alias("_te"))
    return df.join(looked_up, col, "left").withColumn(
        te, F.coalesce(F.col("_te"), default)).drop("_te")


def route_flights(df: DataFrame, origin: str = "origin", dest: str = "dest") -> DataFrame:
    """Flights per route, a written table."""
    return stored(df.groupBy(origin, dest).agg(F.count("*").alias("flights")), "routes")


def route_count(df: DataFrame, totals: DataFrame | None = None, origin: str = "origin",
                dest: str = "dest") -> DataFrame:
    """Number of flights on each row's route; 0 where an end is unknown."""
    if totals is None:
        totals = route_flights(df, origin, dest)
    counts = totals.where(F.col(origin).isNotNull() & F.col(dest).isNotNull()).select(
        origin, dest, F.col("flights").alias("_flights"))
    return df.join(counts, [origin, dest], "left").withColumn(
        "route_count", F.coalesce(F.col("_flights"), F.lit(0))).drop("_flights")


def serving_features(df: DataFrame, maps: Mapping[str, DataFrame],
                     keep: Sequence[str] = ()) -> DataFrame:
    """The scoring service's nine float features, in its order.

    ``df`` has month, day_of_week, hour, route_count, crs_elapsed_time and the encoded columns;
    time_of_day is derived from the hour where it is not given.
    """
    if "time_of_day" not in df.columns:
        df = df.withColumn("time_of_day", time_of_day("hour"))
    for col, mapping in maps.items():
        df = apply_encoding(df, mapping, col)
    return df.select(*keep, *[F.col(f).cast("float").alias(f) for f in SERVING_FEATURES])


__all__ = [
    "CATEGORICAL_FEATURES", "ENCODED_COLUMNS", "NUMERIC_FEATURES", "OTHER", "SERVING_FEATURES",
    "TEST", "TRAIN", "VALIDATION", "apply_encoding", "build_features", "out_of_fold_sums", "route_count", "route_flights", "route_risk",
    "route_totals", "serving_features", "standard_stats", "standardise", "target_encoding",
    "target_encodings",
    "with_grouped_ends", "with_out_of_fold_mean", "with_route_risk", "with_targets", "with_time_features",
]
