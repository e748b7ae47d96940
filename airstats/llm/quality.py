"""Quality rules and an isolation forest over their statistics.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, fails the base rules and is
not kept. Rows are judged one by one: equal texts get equal verdicts, every input row gives one
result row, and extra columns don't matter. Without labelled rows of both kinds the forest rejects
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airstats.llm import text as T
from airstats.storage import stored

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
FEATURES = ("word length", "symbols per word", "repeated lines", "repeated words")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def block_stats(block: T.Block) -> dict[str, np.ndarray]:
    """Statistics of each text of a block."""
    data, count = block.data, len(block)
    words = T.find_words(block, T.SPACED)
    ranges = block.hashes()
    first_bytes = (data & 0xC0) != 0x80

    newline = np.flatnonzero(data == 10)
    filled = block.offsets[:-1][np.diff(block.offsets) > 0]
    starts = np.unique(np.concatenate([filled, newline + 1]))
    starts = starts[starts < len(data)]
    ends = np.full(len(starts), len(data))
    ends[:-1] = starts[1:]
    has_newline = data[ends - 1] == 10 if len(ends) else np.zeros(0, bool)
    ends = ends - has_newline
    with_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[with_word], ends[with_word]
    line_text = np.searchsorted(block.offsets, starts, side="right") - 1
    n_lines = np.bincount(line_text, minlength=count)
    _, first = np.unique(T.joint(ranges(starts, ends), line_text), return_index=True)
    n_dup = n_lines - np.bincount(line_text[first], minlength=count)

    hashes, at = T.shingles(ranges(words.starts, words.ends), words, WINDOW)
    _, back, times = np.unique(T.joint(hashes, words.text[at]), return_inverse=True, return_counts=True)
    repeated = at[times[back] > 1] if len(at) else at
    change = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0

    return {
        "n_words": words.counts(),
        "word_chars": T.per_text(T.SPACED[data] & first_bytes, block.offsets),
        "n_symbols": T.per_text(_SYMBOLS[data], block.offsets),
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(words.text[covered], minlength=count),
    }


def rule_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns of ``STATS`` (long) for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in T.sub_batches(batch, "text"):
                stats = block_stats(block)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), *(pa.array(stats[s].astype(np.int64)) for s in STATS)],
                    names=["key", *STATS])

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{s} long" for s in STATS)])
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the statistics, so that a text's length alone is no anomaly."""
    words = np.maximum(stats["n_words"], 1).astype(float)
    return np.column_stack([
        stats["word_chars"] / words, np.log1p(100 * stats["n_symbols"] / words),
        stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1), stats["n_repeat_words"] / words])


def _usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of a leaf in a random tree over n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 in a leaf), split value, left child, path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows_per_tree: int
    threshold: float = float("inf")
    columns: list[int] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): towards 1 for rows that few splits set apart."""
        x = x if self.columns is None else x[:, self.columns]
        total = np.zeros(len(x))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = left[node] + (x[rows, feature[node]] >= value[node])
            total += path[at]
        usual = float(_usual_path(max(self.rows_per_tree, 2)))
        return 2.0 ** (-total / (max(len(self.trees), 1) * usual))


def grow_forest(x: np.ndarray, trees: int = 100, rows_per_tree: int = 256, seed: int = 7) -> Forest:
    """Random splits of random subsets, to a depth of log2 of their size."""
    rng = np.random.default_rng(seed)
    size = min(rows_per_tree, len(x))
    depth_limit = int(np.ceil(np.log2(max(size, 2))))
    grown = []
    for _ in range(trees if size else 0):
        feature, value, left, path = [], [], [], []
        queue = [(rng.choice(len(x), size, replace=False), 0)]
        done = 0
        while done < len(queue):  # children are numbered in pairs, in the order of the queue
            rows, depth = queue[done]
            part = x[rows]
            spread = np.flatnonzero(part.max(0) > part.min(0)) if depth < depth_limit and len(rows) > 1 else []
            if len(spread):
                f = int(rng.choice(spread))
                low, high = part[:, f].min(), part[:, f].max()
                cut = rng.uniform(low, high)
                cut = cut if cut > low else high
                feature.append(f)
                value.append(cut)
                left.append(len(queue))
                path.append(0.0)
                queue += [(rows[part[:, f] < cut], depth + 1), (rows[part[:, f] >= cut], depth + 1)]
            else:
                feature.append(-1)
                value.append(0.0)
                left.append(0)
                path.append(depth + float(_usual_path(len(rows))))
            done += 1
        grown.append(tuple(map(np.array, (feature, value, left, path))))
    return Forest(grown, size)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with the anomaly score of each row."""
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({s: batch.column(s).to_numpy(zero_copy_only=False) for s in STATS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], names=[*names, "anomaly"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields) + ", anomaly double"
    return stats.mapInArrow(run, schema)


def _score_counts(marked: DataFrame, forests: list[Forest], bins: int) -> DataFrame:
    """How many rows of quality 1 and of others each forest gives a score in each bin."""
    shared = marked.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({s: batch.column(s).to_numpy(zero_copy_only=False) for s in STATS})
            is_good = batch.column("quality").to_numpy(zero_copy_only=False) == 1
            for number, forest in enumerate(shared.value):
                found, at = np.unique(np.floor(forest.score(x) * bins).astype(np.int32), return_inverse=True)
                good = np.bincount(at, is_good, len(found)).astype(np.int64)
                bad = np.bincount(at, ~is_good, len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), number, np.int32)), *map(pa.array, (found, good, bad))],
                    names=["forest", "bin", "good", "bad"])

    found = marked.select(*STATS, "quality").mapInArrow(run, "forest int, bin int, good long, bad long")
    return found.groupBy("forest", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def fit(stats: DataFrame, labels: DataFrame, label_key: str = "doc_id", sample_rows: int = 8192,
        trees: int = 100, rows_per_tree: int = 256, max_clean_loss: float = 0.001, bins: int = 2000,
        row_key: str = "key") -> Forest:
    """Grow forests on ``sample_rows`` rows that pass the base rules (those of the least key
    hashes), one for each set of features, then choose one and its threshold by all labelled rows.

    That is the forest and threshold of best balanced accuracy among those that reject at most
    ``max_clean_loss`` of the rows of quality 1; rare values of a feature that good rows have too
    don't hide the bad ones that way. Equals go to more features, and to the middle of the equal
    thresholds. It comes from counts of scores in ``bins`` bins, so the driver gets no rows.
    ``row_key`` is what of a row's key the labels are for, such as a field of it.
    """
    passing = stats.where(~F.col("base_failed"))
    drawn = (passing.withColumn("at", F.xxhash64(row_key)).orderBy("at", *STATS).limit(sample_rows)
             .select(*STATS).toPandas())
    x = features({s: drawn[s].to_numpy() for s in STATS})
    forests = []
    for size in range(len(FEATURES), 0, -1):
        for columns in map(list, combinations(range(len(FEATURES)), size)):
            forests.append(grow_forest(x[:, columns], trees, rows_per_tree))
            forests[-1].columns = columns
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(label_key).alias("mark")).agg(
        F.max("quality").alias("quality"))
    counted = _score_counts(passing.join(marks, F.col(row_key) == F.col("mark")), forests, bins).toPandas()
    good, bad = np.zeros((len(forests), bins + 2)), np.zeros((len(forests), bins + 2))
    place = counted["forest"].to_numpy(int), counted["bin"].to_numpy(int)
    good[place], bad[place] = counted["good"], counted["bad"]
    chosen, most = forests[0], 0.0
    if good.sum() and bad.sum():
        for forest, of_good, of_bad in zip(forests, good, bad):
            # rejected when the threshold is the lower edge of the bin
            lost, caught = (np.cumsum(n[::-1])[::-1] / n.sum() for n in (of_good, of_bad))
            gain = np.where(lost <= max_clean_loss, caught - lost, -1)
            if gain.max() > most:
                best = np.flatnonzero(gain == gain.max())
                forest.threshold = float(best[len(best) // 2]) / bins
                chosen, most = forest, gain.max()
    return chosen


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key``, the columns of ``STATS``, base_failed, anomaly and kept for each row of ``docs``."""
    stats = stored(rule_stats(docs, key, text), "rules")
    forest = fit(stats, labels, **options)
    return (scored(stats, forest)
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < forest.threshold))
            .withColumnRenamed("key", key))
