"""Benchmark passages in documents, by a prefix-filtered set join of word shingles.

An item's windows are its runs of ``window`` consecutive words (one window if it has fewer). As a
set of shingles, a window that occurs in a text is wholly contained in the text's run of as many
words, so of its shingles ordered by rarity any one must occur: the necessary prefix is the single
rarest one. Items are few against the corpus, so their prefix shingles meet the documents'
shingles; the lengths and the place of the shingle in its window bound where the window could
lie, and the words there are compared one by one.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null and empty texts have no
words; they hit nothing and nothing hits them. Items with equal text and equal keys are each found.
Every document row gives one result row; equal keys are not merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airstats.llm import text as T
from airstats.storage import stored

#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 3
#: Bytes of item text whose windows are given to every task at once; more items take more passes.
ITEM_BYTES = 1 << 20


def _lowered(block: T.Block) -> T.Block:
    return T.Block(block.first, T.lower(block.data), block.offsets)


def _word_hashes(block: T.Block) -> tuple[T.Words, np.ndarray]:
    words = T.find_words(block, T.ALNUM)
    return words, block.hashes()(words.starts, words.ends)


@dataclass
class Windows:
    """Windows of a set of items, and their shingles.

    ``words`` are the word hashes of all items one after the other; window ``i`` is
    ``words[start[i]:start[i] + size[i]]`` of item ``item[i]``. ``sizes`` are the shingle sizes in
    use; ``shingle`` the sorted distinct shingles, ``in_window``/``of_window``/``offset`` the
    occurrences of shingles in windows.
    """

    keys: list
    words: np.ndarray
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray
    sizes: list[int]
    shingle: np.ndarray
    in_window: np.ndarray
    of_window: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, keys: list, texts: list[str | None], window: int, shingle: int = SHINGLE) -> "Windows":
        block = _lowered(T.Block(0, *T.text_bytes(pa.array(texts, pa.string()))))
        words, hashes = _word_hashes(block)
        item, start, size = [], [], []
        for i, (low, high) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
            for s in range(low, max(high - window, low) + 1) if high > low else ():
                item.append(i)
                start.append(s)
                size.append(min(window, high - low))
        size_of = np.array(size, np.int64)
        grams, of_window, offset = [], [], []
        widths = np.minimum(size_of, shingle)
        for width in np.unique(widths).tolist():
            which = np.flatnonzero(widths == width)
            found, at = T.shingles(hashes, words, width)
            place = np.full(len(hashes), -1)
            place[at] = np.arange(len(at))
            for w in which.tolist():
                for o in range(size[w] - width + 1):
                    grams.append(found[place[start[w] + o]] ^ np.uint64(width))
                    of_window.append(w)
                    offset.append(o)
        distinct, where = np.unique(np.array(grams, np.uint64), return_inverse=True)
        return cls(keys, hashes, np.array(item, np.int64), np.array(start, np.int64), size_of,
                   np.unique(widths).tolist(), distinct, where.astype(np.int64),
                   np.array(of_window, np.int64), np.array(offset, np.int64))

    def occurrences(self, hashes: np.ndarray, words: T.Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the shingles of ``wanted`` in a block, and the word each begins at."""
        number, place = [], []
        for width in self.sizes:
            grams, at = T.shingles(hashes, words, width)
            grams = grams ^ np.uint64(width)
            low = np.searchsorted(wanted, grams)
            low[low == len(wanted)] = 0
            hit = np.flatnonzero(wanted[low] == grams) if len(wanted) else np.zeros(0, np.int64)
            number.append(low[hit])
            place.append(at[hit])
        if not number:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(number), np.concatenate(place)

    def prefixes(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rarest shingle of each window (of equal ones the least): shingle, window, offset."""
        order = np.lexsort((self.offset, self.in_window, frequency[self.in_window], self.of_window))
        _, first = np.unique(self.of_window[order], return_index=True)
        rows = order[first]
        return self.in_window[rows], self.of_window[rows], self.offset[rows]


class Matcher:
    """Finds occurrences of windows in blocks through their prefix shingles."""

    def __init__(self, windows: Windows, frequency: np.ndarray):
        shingle, window, offset = windows.prefixes(frequency)
        order = np.argsort(shingle, kind="stable")
        self.windows = windows
        self.window, self.offset = window[order], offset[order]
        used, counts = np.unique(shingle[order], return_counts=True)
        self.wanted = windows.shingle[used]
        self.bounds = np.concatenate([[0], np.cumsum(counts)])

    def __call__(self, hashes: np.ndarray, words: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Window and first word of each occurrence."""
        w = self.windows
        number, place = w.occurrences(hashes, words, self.wanted)
        many = self.bounds[number + 1] - self.bounds[number]
        row = np.repeat(self.bounds[number] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        window, first = self.window[row], np.repeat(place, many) - self.offset[row]
        size, text = w.size[window], words.text[np.repeat(place, many)]
        # place and length: the window must lie within the words of the text
        fits = (first >= words.bounds[text]) & (first + size <= words.bounds[text + 1])
        window, first, size = window[fits], first[fits], size[fits]
        for k in range(int(size.max()) if len(size) else 0):
            same = k >= size
            inner = np.flatnonzero(~same)
            same[inner] = hashes[first[inner] + k] == w.words[w.start[window[inner]] + k]
            window, first, size = window[same], first[same], size[same]
        return window, first


def _frequency(docs: DataFrame, shared) -> np.ndarray:
    """How often each shingle of the shared windows occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        total = np.zeros(len(windows.shingle), np.int64)
        for batch in batches:
            for block in map(_lowered, T.blocks(batch.column("text"))):
                words, hashes = _word_hashes(block)
                number, _ = windows.occurrences(hashes, words, windows.shingle)
                total += np.bincount(number, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

    counts = docs.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(shared.value.shingle), np.int64)
    out[counts["shingle"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def _groups(items: DataFrame, key: str, text: str, limit: int) -> Iterator[tuple[list, list]]:
    """Items in groups of at most ``limit`` bytes of text (one item at least)."""
    keys, texts, size, total = [], [], 0, 0
    for row in items.select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        more = len((row["text"] or "").encode())
        if keys and size + more > limit:
            yield keys, texts
            keys, texts, size, total = [], [], 0, total + 1
        keys.append(row["key"])
        texts.append(row["text"])
        size += more
    if keys or not total:  # without items, one group of none
        yield keys, texts


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = 10,
                  item_bytes: int = ITEM_BYTES) -> DataFrame:
    """For each row of ``docs``: ``key``, n_words, hits (array of first and last word of each run
    of hit words, struct<first:int, last:int>) and items (sorted array of item keys as text).

    Items go to the tasks in groups of at most ``item_bytes`` of text. One group, the usual case,
    takes two passes over the documents: one counts how rare each shingle is, one searches. Each
    further group takes two more, and the results are joined on the rows' own numbers.
    """
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    if total > item_bytes:
        narrow = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "numbered")
    else:
        narrow = narrow.withColumn("row", F.lit(0).cast("long"))

    def search(shared, frequency) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(shared.value, frequency.value)
            names = [str(k) for k in shared.value.keys]
            for batch in batches:
                for rows, block in T.sub_batches(batch, "text"):
                    block = _lowered(block)
                    words, hashes = _word_hashes(block)
                    found, first = match(hashes, words)
                    hits, items_of = _collected(match.windows, words, found, first, names)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("row"), rows.column("key"), pa.array(words.counts()), pa.array(hits, _HITS),
                         pa.array(items_of, pa.list_(pa.string()))], names=["row", "key", "n_words", "hits", "items"])

        return narrow.mapInArrow(run, f"row long, key {kind}, n_words long, hits array<struct<first:int,last:int>>, items array<string>")

    found = None
    for keys, texts in _groups(items, item_key, item_text, item_bytes):
        shared = spark.sparkContext.broadcast(Windows.of(keys, texts, window))
        frequency = spark.sparkContext.broadcast(_frequency(narrow.select("text"), shared))
        part = search(shared, frequency)
        found = part if found is None else _merged(found, part)
    return found.drop("row").withColumnRenamed("key", key)


_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _collected(windows: Windows, words: T.Words, found: np.ndarray, first: np.ndarray,
               names: list[str]) -> tuple[list, list]:
    """Runs of hit words and the items of each text of a block."""
    count = len(words.bounds) - 1
    hits: list[list[dict]] = [[] for _ in range(count)]
    items: list[list[str]] = [[] for _ in range(count)]
    if len(found):
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + windows.size[found], -1)
        covered = np.cumsum(change)[:-1] > 0
        at = np.flatnonzero(covered)
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(words.text[at]) > 0))
        lows = at[np.concatenate([[0], breaks + 1])]
        highs = at[np.concatenate([breaks, [len(at) - 1]])]
        for low, high in zip(lows.tolist(), highs.tolist()):
            t = words.text[low]
            hits[t].append({"first": low - int(words.bounds[t]), "last": high - int(words.bounds[t])})
        pairs = np.unique(np.column_stack([words.text[first], windows.item[found]]), axis=0)
        for t, i in pairs.tolist():
            items[t].append(names[i])
        for t in np.unique(pairs[:, 0]).tolist():
            items[t].sort()
    return hits, items


def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Results of two groups of items for the same numbered rows."""
    both = one.join(other.select("row", F.col("hits").alias("hits_2"), F.col("items").alias("items_2")), "row")
    return both.select(
        "row", "key", "n_words", _joined(F.concat("hits", "hits_2")).alias("hits"),
        F.array_sort(F.concat("items", "items_2")).alias("items"))


def _joined(hits):
    """Runs of words in order, with those that overlap or touch made one."""
    return F.aggregate(
        F.array_sort(hits), F.expr("cast(array() as array<struct<first:int,last:int>>)"),
        lambda done, run: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= run["first"]),
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"),
                F.greatest(F.element_at(done, -1)["last"], run["last"]).alias("last")))))
        .otherwise(F.concat(done, F.array(run))))


def item_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_hit, n_items, items_sha256 and contaminated of :func:`contamination`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))
