"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of those of three hash buckets: the whole word's and those of its first
four and five bytes, so that forms of one stem share most of it. Buckets that too few learning texts
have are zero, so that unknown words say nothing. Filters of several widths run over the whole text, each
filter's largest answer counts, and a dense layer turns these into one logit. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The language that the thresholds are
calibrated by is told from the text's own function words, so nothing but the text enters a score.

Null and empty texts (and texts without words) get the score of a text without findings. Rows are
scored one by one; equal texts get equal scores. With labels of one kind only, or none, every text
gets the score 0 or the share of the kind there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airstats.llm import text as T

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 12, (1, 2, 3), 8
#: Bytes of a word's beginnings that have a bucket of their own besides the whole word.
STEMS = (4, 5)
#: Learning texts that must have a bucket.
LEAST_TEXTS = 3
#: Bins of a logit's unit when labelled texts are counted, and the largest logit that is told apart.
BINS, MOST = 64, 128

# fixed values: frequent function words of each language
FUNCTION_WORDS = {
    "en": "the of and to is was it for on are as with that this by from be not at or an have you".split(),
    "fr": "le la les des et un une du est que qui dans pour pas sur au avec par de ce il elle".split(),
    "de": "der die das und ist nicht ein eine zu den mit von sich auf für im dem auch es wird".split(),
    "es": "el la los las que y en un una por con para se del es no al lo como su más de".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)


def _hash_words(words: list[str]) -> np.ndarray:
    block = next(T.blocks(pa.array(words)))
    return block.hashes()(block.offsets[:-1], block.offsets[1:])


def _language_votes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and the languages that have each word, as 0/1 columns."""
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    hashes = _hash_words(words)
    member = np.array([[w in FUNCTION_WORDS[lang] for lang in LANGUAGES] for w in words], float)
    order = np.argsort(hashes)
    return hashes[order], member[order]


_VOTES = _language_votes()


@dataclass
class Texts:
    """Buckets of the words of several texts (a row each), bounds, and each text's language number."""

    bucket: np.ndarray
    bounds: np.ndarray
    language: np.ndarray

    @classmethod
    def of(cls, block: T.Block) -> "Texts":
        block = T.Block(0, T.lower(block.data), block.offsets)
        words = T.find_words(block, T.ALNUM)
        block_hash = block.hashes()
        hashes = block_hash(words.starts, words.ends)
        known, member = _VOTES
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = np.flatnonzero(known[at] == hashes) if len(hashes) else np.zeros(0, np.int64)
        votes = np.column_stack([
            np.bincount(words.text[hit], member[at[hit], i], minlength=len(block)) for i in range(len(LANGUAGES))])
        ranges = [hashes] + [T.mixed(block_hash(words.starts, np.minimum(words.starts + n, words.ends)) + np.uint64(n))
                             for n in STEMS]
        return cls(np.column_stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in ranges]), words.bounds,
                   votes.argmax(1))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def part(self, rows: np.ndarray) -> "Texts":
        lows, highs = self.bounds[rows], self.bounds[rows + 1]
        bucket = np.concatenate([self.bucket[a:b] for a, b in zip(lows, highs)]) if len(rows) else self.bucket[:0]
        return Texts(bucket, np.concatenate([[0], np.cumsum(highs - lows)]), self.language[rows])


def _pooled(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter over the windows of each text, and which texts have windows."""
    starts, lengths = bounds[:-1], np.diff(bounds) - width + 1
    has = np.flatnonzero(lengths > 0)
    out = np.zeros((len(starts), values.shape[1]), np.float32)
    if len(has):
        # windows that reach into the next text are passed over by giving each text its own slice
        cuts = np.column_stack([starts[has], starts[has] + lengths[has]]).ravel()
        cuts = cuts[:-1] if cuts[-1] >= len(values) else cuts
        out[has] = np.maximum.reduceat(values, cuts, axis=0)[::2]
    return np.maximum(out, 0), has


class Classifier:
    """Hashed embeddings, one convolution per width, max pooling and a dense layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.kernel = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.offset = np.float32(0)
        self.threshold = np.zeros(len(LANGUAGES), np.float32)

    def table(self) -> np.ndarray:
        """What each bucket adds to each filter at each place; makes scoring a sum of look-ups."""
        return self.embed @ np.hstack([k[j] for k in self.kernel.values() for j in range(len(k))])

    def logits(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        added = table[texts.bucket[:, 0]]
        for i in range(1, texts.bucket.shape[1]):
            added += table[texts.bucket[:, i]]
        parts, at = [], 0
        for w in WIDTHS:
            count = max(len(added) - w + 1, 0)
            values = np.tile(self.bias[w], (count, 1))
            for j in range(w):
                values += added[j:j + count, at:at + FILTERS]
                at += FILTERS
            parts.append(_pooled(values, texts.bounds, w)[0])
        return np.hstack(parts) @ self.dense + self.offset

    def scores(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the calibrated threshold of the text's language."""
        z = (self.logits(texts, table) - self.threshold[texts.language]).astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def fit(self, texts: Texts, labels: np.ndarray, texts_seen: int = 16_000, batch: int = 32,
            rate: float = 0.08, seed: int = 5) -> None:
        """Adagrad on the weighted log loss; only the windows that pooling chose get gradients.

        Texts are gone through until ``texts_seen`` have been learnt from, 4 to 24 times.
        """
        epochs = int(np.clip(texts_seen // max(len(texts), 1), 4, 24))
        rng = np.random.default_rng(seed)
        texts_with = np.zeros(BUCKETS, np.int32)
        of = np.repeat(np.arange(len(texts)), np.diff(texts.bounds))
        for column in texts.bucket.T:
            pairs = np.unique(column.astype(np.int64) * len(texts) + of)
            texts_with += np.bincount(pairs // len(texts), minlength=BUCKETS).astype(np.int32)
        known = texts_with >= LEAST_TEXTS
        self.embed[~known] = 0
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        squares = {"embed": np.full(self.embed.shape, 1e-3, np.float32), "dense": np.full(self.dense.shape, 1e-3, np.float32),
                   "offset": np.float32(1e-3)}
        squares |= {("kernel", w): np.full(k.shape, 1e-3, np.float32) for w, k in self.kernel.items()}
        squares |= {("bias", w): np.full(b.shape, 1e-3, np.float32) for w, b in self.bias.items()}

        def step(name, value, gradient):
            squares[name] += gradient * gradient
            value -= rate * gradient / np.sqrt(squares[name])
            return value

        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at:at + batch]
                part = texts.part(rows)
                embedded = self.embed[part.bucket].sum(1)
                pooled, chosen = [], {}
                for w in WIDTHS:
                    count = max(len(part.bucket) - w + 1, 0)
                    values = np.tile(self.bias[w], (count, 1))
                    for j in range(w):
                        values += embedded[j:j + count] @ self.kernel[w][j]
                    best, has = _pooled(values, part.bounds, w)
                    place = np.full(best.shape, -1)
                    for t in has.tolist():
                        low = part.bounds[t]
                        place[t] = low + values[low:part.bounds[t + 1] - w + 1].argmax(0)
                    place[best <= 0] = -1
                    pooled.append(best)
                    chosen[w] = place
                x = np.hstack(pooled)
                z = x @ self.dense + self.offset
                error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                to_pool = error[:, None] * self.dense[None, :]
                embed_gradient: dict = {"at": [], "by": []}
                for i, w in enumerate(WIDTHS):
                    place = chosen[w]
                    t, f = np.nonzero(place >= 0)
                    p, g = place[t, f], to_pool[:, i * FILTERS:(i + 1) * FILTERS][t, f]
                    kernel_gradient = np.zeros_like(self.kernel[w])
                    for j in range(w):
                        np.add.at(kernel_gradient[j].T, f, g[:, None] * embedded[p + j])
                        for bucket in part.bucket[p + j].T:
                            embed_gradient["at"].append(bucket)
                            embed_gradient["by"].append(g[:, None] * self.kernel[w][j][:, f].T)
                    self.kernel[w] = step(("kernel", w), self.kernel[w], kernel_gradient)
                    self.bias[w] = step(("bias", w), self.bias[w], np.bincount(f, g, FILTERS).astype(np.float32))
                rows_at, inverse = np.unique(np.concatenate(embed_gradient["at"]), return_inverse=True)
                summed = np.zeros((len(rows_at), DIM), np.float32)
                np.add.at(summed, inverse, np.concatenate(embed_gradient["by"]))
                summed *= known[rows_at, None]
                squares["embed"][rows_at] += summed * summed
                self.embed[rows_at] -= rate * summed / np.sqrt(squares["embed"][rows_at])
                self.dense = step("dense", self.dense, x.T @ error)
                self.offset = step("offset", self.offset, np.float32(error.sum()))

    def calibrate(self, counted: pa.Table, least: int = 20) -> None:
        """Per language, the logit that tells the two kinds apart best, and with most room.

        ``counted`` has language, bin (of the logit), toxic and clean, as ``logit_counts`` gives them.
        Languages with fewer than ``least`` labelled texts of either kind get the threshold of all.
        """
        language, place, toxic, clean = (counted[c].to_numpy() for c in ("language", "bin", "toxic", "clean"))
        self.threshold[:] = _cut(place, toxic, clean)
        for i in range(len(LANGUAGES)):
            of = language == i
            if min(toxic[of].sum(), clean[of].sum()) >= least:
                self.threshold[i] = _cut(place[of], toxic[of], clean[of])


def _cut(place: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit with fewest errors between bins, where toxic and clean texts are counted."""
    z, back = np.unique(place, return_inverse=True)
    toxic, clean = np.bincount(back, toxic), np.bincount(back, clean)
    # wrong when all from place i on count as toxic
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    z = (z + 0.5) / BINS
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    room = np.concatenate([[0], np.diff(z), [0]])
    best = np.flatnonzero(wrong == wrong.min())
    return float(edges[best[room[best].argmax()]])


def logit_counts(docs: DataFrame, marks: DataFrame, model: Classifier) -> DataFrame:
    """How many toxic and clean texts there are for each language and bin of logits.

    ``docs`` has key and text, ``marks`` key and label. All labelled rows count; only keys, languages
    and bins are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        table = fitted.table()
        for batch in batches:
            for rows, block in T.sub_batches(batch, "text"):
                texts = Texts.of(block)
                place = np.floor(np.clip(fitted.logits(texts, table), -MOST, MOST) * BINS)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), pa.array(texts.language.astype(np.int32)), pa.array(place.astype(np.int32))],
                    names=["key", "language", "bin"])

    kind = docs.select("key").schema[0].dataType.simpleString()
    found = docs.select("key", "text").mapInArrow(run, f"key {kind}, language int, bin int")
    return found.join(marks, "key").groupBy("language", "bin").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          toxic_rows: int = 1400, clean_rows: int = 2600) -> Classifier | float:
    """A classifier learnt from at most ``toxic_rows`` + ``clean_rows`` labelled rows, whole texts.

    The rows are those of the least key hashes of each kind; a fifth of them is not learnt from. The
    thresholds are set by all labelled rows of ``docs``, in the mix they have, from counts of their
    logits. Without both kinds the result is the share of toxic rows.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    ranked = marks.withColumn("at", F.xxhash64(F.col("key"), F.lit(1)))
    drawn = None
    for value, limit in ((1, toxic_rows), (0, clean_rows)):
        part = ranked.where(F.col("label") == value).orderBy("at", "key").limit(limit)
        drawn = part if drawn is None else drawn.unionAll(part)
    whole = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = whole.join(F.broadcast(drawn), "key").select("label", "text", "at").toArrow().sort_by("at")
    kinds = np.array(rows.column("label").to_pylist(), np.int64)
    if len(set(kinds.tolist())) < 2:
        return float(kinds.mean()) if len(kinds) else 0.0
    parts = [Texts.of(block) for block in T.blocks(rows.column("text"))]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.bounds) for p in parts]))])
    texts = Texts(np.concatenate([p.bucket for p in parts]), bounds, np.concatenate([p.language for p in parts]))
    model = Classifier()
    own = np.arange(len(kinds)) % 5 != 0
    if len(set(kinds[own].tolist())) < 2:
        own[:] = True
    model.fit(texts.part(np.flatnonzero(own)), kinds[own])
    model.calibrate(logit_counts(whole, marks, model).toArrow())
    return model


def scored(docs: DataFrame, model: Classifier | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        table = fitted.table() if isinstance(fitted, Classifier) else None
        for batch in batches:
            for rows, block in T.sub_batches(batch, "text"):
                score = np.full(len(block), fitted) if table is None else fitted.scores(Texts.of(block), table)
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(score, pa.float64())], names=["key", "score"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("key", key))
