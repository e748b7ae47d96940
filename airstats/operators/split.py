"""Stratified train/test split and balanced class weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from airstats.functions import hash52, key_text, uniform
from airstats.operators.features import TEST, TRAIN, VALIDATION
from airstats.storage import stored

# Fixed values.
TEST_SHARE = 0.2
SPLIT_SEED = 42
CLASSES = (0, 1, 2, 3)

# Bins times classes are counted, level by level of hash bits, until the bin in which a class fills up
# has at most so many rows; those are ranked in one task.
_BIN_BITS = 14
_EDGE_ROWS = 100_000
_HASH_BITS = 52


def class_quotas(counts: DataFrame, label: str, test: float = TEST_SHARE) -> DataFrame:
    """Test rows of each class: ceil(test * n) shared out in proportion by largest remainder.

    ``counts`` holds one row per class with its size ``n``. Spare rows go to the largest
    remainders, among equals to the lowest class.
    """
    sizes = counts.select(label, F.col("n").cast("decimal(18,0)").alias("n"))
    total = sizes.agg(F.sum("n").cast("decimal(18,0)")).scalar()
    wanted = F.ceil(total.cast("double") * test).cast("decimal(18,0)")
    shared = sizes.withColumns({"_all": total, "_wanted": wanted}).withColumns({
        "_base": F.expr("cast(floor(n * _wanted / _all) as bigint)"),
        "_rest": F.expr("(n * _wanted) % _all"),
    })
    # One row per class: the window without partitions sees only those.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), label)
    spare = F.col("_wanted").cast("bigint") - F.sum("_base").over(Window.partitionBy(F.lit(0)))
    return shared.withColumn(
        "quota", F.col("_base") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)
    ).select(label, "quota")


def stratified_split(df: DataFrame, label: str, key: str | Sequence[str], test: float = TEST_SHARE,
                     seed: int = SPLIT_SEED, exact: bool = True, validation: float = 0.0) -> DataFrame:
    """Add ``split``: test, validation (if a share is given for it) or train, decided by a hash of the
    row's unique key. The test rows are the same with and without a validation part.

    ``exact=False`` compares the hash with the shares row by row, class sizes are then only close.

    ``exact=True`` gives every class its quota without shuffling the rows, however unequal the
    classes are: counters per class and leading hash bits show in which bin of hashes a class
    fills up, further bits divide a bin of many rows, the few keys left are ranked to find the last
    one in, and the rows are then compared with that one; all parts come from the same counters.
    Should a key have copies, all of them go where the first one goes.
    """
    text = key_text(key)
    # a part's share with those of the parts before it
    shares = {TEST: test} | ({VALIDATION: test + validation} if validation else {})
    if not exact:
        drawn = uniform(hash52(text, seed))
        return df.withColumn("split", _first([(drawn < share, part) for part, share in shares.items()]))

    drawn = df.withColumns({"_hash": hash52(text, seed), "_key": text})
    keys = drawn.select(label, "_hash", "_key")
    bits = min(_BIN_BITS, _HASH_BITS)
    bins = _counted(keys, label, bits)
    sizes = bins.groupBy(label).agg(F.sum("_n").alias("n"))
    quotas = [class_quotas(sizes, label, share).select(label, F.lit(part).alias("_part"), F.col("quota").alias("_wanted"))
              for part, share in shares.items()]
    edges = _edges(bins, reduce(DataFrame.union, quotas), label)
    while bits < _HASH_BITS and (edges.agg(F.max("_n")).head()[0] or 0) > _EDGE_ROWS:
        narrowed = _at_edge(keys, edges, label, bits)
        bits = min(bits + _BIN_BITS, _HASH_BITS)
        edges = _edges(_counted(narrowed, label, bits), edges.select(label, "_part", F.col("_left").alias("_wanted")), label)
    # Copies of a key are added up before they meet; they stay on one side of the split.
    at_edge = _at_edge(keys, edges, label, bits).groupBy(label, "_part", "_hash", "_key").agg(
        F.count("*").alias("_n"), F.max("_left").alias("_left"))
    reached = F.sum("_n").over(Window.partitionBy(label, "_part").orderBy("_hash", "_key"))
    last_in = at_edge.withColumn("_reached", reached).where(
        (F.col("_reached") >= F.col("_left")) & (F.col("_reached") - F.col("_n") < F.col("_left")))
    place = F.struct("_hash", "_key")
    last_in = stored(last_in.groupBy(label).agg(
        *[F.max(F.when(F.col("_part") == part, place)).alias(f"_last_{part}") for part in shares]), "split-last")

    def inside(part: str) -> Column:
        last = F.col(f"_last_{part}")
        return (F.col("_hash") < last["_hash"]) | ((F.col("_hash") == last["_hash"]) & (F.col("_key") <= last["_key"]))

    return (
        drawn.join(last_in, label, "left")
        .withColumn("split", _first([(inside(part), part) for part in shares]))
        .select(*df.columns, "split")
    )


def _first(cases: Sequence[tuple[Column, str]]) -> Column:
    """The part of the first condition that holds, else train."""
    out = F.lit(TRAIN)
    for holds, part in reversed(cases):
        out = F.when(holds, part).otherwise(out)
    return out


def _by(df: DataFrame, label: str) -> list[str]:
    """Class, and the part whose edge is looked for once parts are told apart."""
    return [label, "_part"] if "_part" in df.columns else [label]


def _counted(keys: DataFrame, label: str, bits: int) -> DataFrame:
    """Rows per class and leading bits of the hash, a written table."""
    bins = keys.groupBy(*_by(keys, label), F.shiftright("_hash", _HASH_BITS - bits).alias("_bin"))
    return stored(bins.agg(F.count("*").alias("_n")), "split-bins")


def _edges(bins: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """The bin in which each class reaches the rows wanted for a part, its rows, and how many of them get in."""
    by = _by(bins, label)
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("_n")
    return stored(
        bins.withColumn("_before", before).join(wanted, by)
        .where((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_n")))
        .select(label, "_part", F.col("_bin").alias("_edge"), "_n", (F.col("_wanted") - F.col("_before")).alias("_left")),
        "split-edges")


def _at_edge(keys: DataFrame, edges: DataFrame, label: str, bits: int) -> DataFrame:
    """Keys whose hash begins with the bits of a bin at an edge of their class."""
    return keys.join(edges.drop("_n"), label).where(F.shiftright("_hash", _HASH_BITS - bits) == F.col("_edge"))


def with_balanced_weight(df: DataFrame, label: str, classes: Sequence[int] = CLASSES,
                         fit_on: DataFrame | None = None, out: str = "weight") -> DataFrame:
    """n / (k * n_c), k the number of classes that occur. Counts are one row, no join is needed."""
    source = df if fit_on is None else fit_on
    counts = source.agg(F.struct(
        F.count(label).alias("n"), *[F.count_if(F.col(label) == c).alias(f"c{c}") for c in classes])).scalar()
    k = sum((F.when(counts[f"c{c}"] > 0, 1).otherwise(0) for c in classes), F.lit(0))
    weight = F.lit(None).cast("double")
    for c in classes:
        own = F.nullif(k * counts[f"c{c}"], F.lit(0))
        weight = F.when(F.col(label) == c, counts["n"].cast("double") / own).otherwise(weight)
    return df.withColumn(out, weight)
