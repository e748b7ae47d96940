"""Removal of repeated passages by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else as well. Positions
that content itself selects stand for all: in every ``length`` bytes the least hash of ``gram``
bytes marks an anchor, so equal strings have equal anchors at equal places.

Spark sorts the anchors by their rank, which stands for the text from an anchor on to the next.
In each round an anchor's rank and that of the anchor 1, 2, 4, ... places on are paired, pairs
that occur once leave, and equal pairs get a rank of their own, until a text is unique or past the
length. What is then left open are the ends of passages: starts whose anchor is repeated but whose
passage is not known to be. They are looked at in ever smaller cells of neighbouring starts: a cell
is closed if all bytes that its strings cover are repeated together, given up if what they have in
common is not, and else divided, down to single starts. So the result is exact to the byte, but
for collisions of 64-bit hashes.

Texts are UTF-8 bytes, null counts as empty; shorter ones than ``length`` lose nothing. Equal texts
are taken for one, whose repetition is known; each row has its own result row. No rank, gram or
string is gathered in one task: groups are joined with the least and the greatest position of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airstats.llm import text as T
from airstats.llm.phases import finished, release


def anchors(block: T.Block, ranges: T.Ranges, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, place, and first and last start of each anchor; a start belongs to the anchor of the
    ``length`` bytes that begin there. Places count from the block's begin."""
    size = len(block.data)
    if size < length:
        return (np.zeros(0, np.int64),) * 4
    bits = np.uint64(size.bit_length())
    at = np.arange(size - gram + 1)
    key = (ranges(at, at + gram) >> bits << bits) | at.astype(np.uint64)
    window, span = length - gram + 1, 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[:len(key) - (window - span)], key[window - span:])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(place))
    text = np.searchsorted(block.offsets, starts, side="right") - 1
    fits = starts + length <= block.offsets[text + 1]
    starts, place, text = starts[fits], place[fits], text[fits]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return text[new], place[new], starts[new], starts[last]


def _anchor_rows(length: int, gram: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of anchors: text, number, place, first and last start, gram's hash, and the first anchor at
    least ``step`` bytes on, with the end of its gram and the hash of the text up to there (null
    where there is none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, block in T.sub_batches(batch, "text"):
                docs = part.column("doc").to_pylist()
                fresh = np.array([d not in seen and not seen.add(d) for d in docs], bool)
                ranges = block.hashes()
                text, place, low, high = anchors(block, ranges, length, gram)
                keep = fresh[text]
                text, place, low, high = text[keep], place[keep], low[keep], high[keep]
                if not len(text):
                    continue
                base = block.offsets[text]
                first = np.searchsorted(text, text)
                # places grow within a text and from text to text
                then = np.searchsorted(place, place + step)
                has_next = then < len(text)
                then[~has_next] = 0
                has_next &= text[then] == text
                end = np.where(has_next, place[then], place) + gram
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(text)), pa.array((np.arange(len(text)) - first).astype(np.int32)),
                     pa.array((place - base).astype(np.int32)), pa.array((low - base).astype(np.int32)),
                     pa.array((high - base).astype(np.int32)), pa.array(ranges(place, place + gram).view(np.int64)),
                     pa.array((then - first).astype(np.int32), mask=~has_next),
                     pa.array((end - base).astype(np.int32), mask=~has_next),
                     pa.array(ranges(place, end).view(np.int64), mask=~has_next)],
                    names=["doc", "i", "place", "low", "high", "gram", "then", "stop", "rank"])

    return run


def repeated(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows whose ``keys`` occur at two positions or more, with the least of them as ``least``."""
    found = (rows.groupBy(*keys).agg(F.min(position).alias("least"), F.max(position).alias("greatest"))
             .where("least <> greatest").drop("greatest"))
    return rows.join(found, keys)


def _doubled(anchored: DataFrame, length: int, past: int) -> DataFrame:
    """Intervals of starts (``doc``, ``low``, ``high``) whose passages the doubling finds repeated."""
    columns = ["doc", "i", "id", "place", "then", "stop"]
    state = finished(repeated(anchored.where("rank is not null"), ["rank"], "id")
                     .select(*columns, F.col("least").alias("rank"), F.lit(0).alias("level")), "ranks")
    level, found = 0, [state]
    while True:
        short = state.where((F.col("stop") - F.col("place") < past) & (F.col("level") == level))
        if short.isEmpty():
            break
        # a text that is past the length keeps its rank; the level tells such ranks from newer ones
        after = state.select("doc", F.col("i").alias("then"), F.col("then").alias("then_2"), F.col("stop").alias("stop_2"),
                             F.col("rank").alias("rank_2"), F.col("level").alias("level_2"))
        pairs = finished(short.join(after, ["doc", "then"]), "pairs")
        level += 1
        more = finished(repeated(pairs, ["rank", "rank_2", "level_2"], "id").select(
            "doc", "i", "id", "place", F.col("then_2").alias("then"), F.col("stop_2").alias("stop"),
            F.col("least").alias("rank"), F.lit(level).alias("level")), "ranks")
        found.append(more)
        state = more.unionByName(state.where(F.col("stop") - F.col("place") >= past))
        release(pairs)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    known = finished(whole.where(F.col("stop") - F.col("place") >= length)
                     .groupBy("doc", "place").agg(F.max("stop").alias("stop"))
                     .select("doc", F.col("place").alias("low"), (F.col("stop") - length).alias("high")), "doubled")
    release(*found)
    return known


def _mask(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Flags of the starts within ranges (first and last start)."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high + 1, -1)
    return np.cumsum(change)[:-1] > 0


def _listed(column: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Bounds of each row's structs, and the named fields of all of them; a null row has none."""
    bounds = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    own = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    return bounds - bounds[0], *(own.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)


def _cell_rows(length: int, cell: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each cell of starts of repeated anchors: the hash of the bytes all its strings have, that of
    the bytes any of them has (null where the text ends before), and whether some of its starts are
    open. Cells are counted back from their anchor, so equal passages have equal cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out = batch.column("doc"), []
            bytes_of, text_at = T.text_bytes(batch.column("text"))
            mark_at, *marks = _listed(batch.column("marks"), "place", "low", "high", "open")
            known_at, *known = _listed(batch.column("known"), "low", "high")
            for row in range(len(batch)):
                data = bytes_of[text_at[row]:text_at[row + 1]]
                spans = [f[known_at[row]:known_at[row + 1]] for f in known]
                ranges, resolved = T.Ranges(data), _mask(len(data) + 1, *spans)
                open_before = np.concatenate([[0], np.cumsum(~resolved)])
                place, low, high, was_open = (f[mark_at[row]:mark_at[row + 1]] for f in marks)
                first, last = (place - high) // cell, (place - low) // cell
                many = last - first + 1
                owner = np.repeat(np.arange(len(place)), many)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
                begin = place[owner] - number * cell  # the cell's starts are begin - cell + 1 .. begin
                stop = begin - cell + 1 + length
                a, b = np.maximum(begin - cell + 1, low[owner]), np.minimum(begin, high[owner])
                is_open = (open_before[b + 1] - open_before[a] > 0) & (was_open[owner] > 0)
                key = T.mixed(ranges(begin, stop) ^ number.astype(np.uint64))
                inside = (begin - cell + 1 >= 0) & (begin + length <= len(data))
                wide = np.zeros(len(owner), np.uint64)
                wide[inside] = ranges(begin[inside] - cell + 1, begin[inside] + length)
                out.append((np.full(len(owner), row), place[owner], a, b, is_open, key, wide, ~inside, begin))
            if out:
                row, place, a, b, is_open, key, wide, beyond, begin = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(is_open),
                     pa.array(key.view(np.int64)), pa.array(wide.view(np.int64), mask=beyond),
                     pa.array(begin.astype(np.int32))],
                    names=["doc", "place", "low", "high", "open", "key", "wide", "begin"])

    return run


def repeated_starts(texts: DataFrame, copies: DataFrame, length: int, gram: int, cell: int) -> DataFrame:
    """Intervals (``doc``, ``low``, ``high``) of all starts of strings that start elsewhere too.

    ``texts`` has ``doc`` (binary digest of the text), ``key`` and ``text``; of equal texts, which
    ``copies`` lists, the row of the least key (``first``) stands for all.
    """
    def once(found: DataFrame) -> DataFrame:
        """The texts of ``found``, each once."""
        of = found.join(copies.select("doc", "first"), "doc", "left")
        return texts.join(of, "doc").where("first is null or key = first").drop("first", "key")

    past = 2 * length - gram + 1  # so much repeated text leaves no start open up to the next anchor
    rows = finished(texts.select("doc", "text").mapInArrow(
        _anchor_rows(length, gram, -(-(past - gram) // 4)),
        "doc binary, i int, place int, low int, high int, gram long, then int, stop int, rank long"), "anchors")
    anchored = finished(repeated(rows.withColumn("id", F.xxhash64("doc", "place")), ["gram"], "id")
                        .drop("least", "gram").dropDuplicates(["doc", "i"]), "repeated")
    release(rows)
    known = _doubled(anchored, length, past)

    spans = known.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("known"))
    marks = anchored.select("doc", "place", "low", "high", F.lit(1).alias("open"))
    found, last = known.select("doc", "low", "high"), anchored
    while True:
        of_doc = marks.groupBy("doc").agg(F.collect_list(F.struct("place", "low", "high", "open")).alias("marks"))
        of_doc = of_doc.join(spans, "doc", "left") if spans is not None else of_doc.withColumn(
            "known", F.lit(None).cast("array<struct<low:int,high:int>>"))
        cells = finished(once(of_doc).select("doc", "text", "marks", "known").mapInArrow(
            _cell_rows(length, cell),
            "doc binary, place int, low int, high int, open boolean, key long, wide long, begin int"), "cells")
        release(last)
        # neighbouring anchors may share a cell's place, each with its own starts; the place is the id
        named = cells.withColumn("id", F.xxhash64("doc", "begin"))
        ends = [F.min("id").alias("least"), F.max("id").alias("greatest"), F.max("open").alias("any_open")]
        # stored, so that a hot string's cells meet it in a join that AQE divides; only open cells need to
        wide = finished(named.where("wide is not null").groupBy("wide").agg(*ends)
                        .where("least <> greatest and any_open").select("wide", F.lit(True).alias("closed")), "wide")
        asked = F.col("open") & F.col("wide").isNotNull()
        if cell == 1:
            found = found.union(finished(named.where(asked).join(wide, "wide").select("doc", "low", "high"), "closed"))
            release(cells, wide)
            return found
        judged = named.where(asked).join(wide, "wide", "left").unionByName(
            named.where(~asked).withColumn("closed", F.lit(None).cast("boolean")))
        last = finished(judged.select(
            "doc", "place", "low", "high", "key", "begin", "closed",
            (F.col("open") & F.col("closed").isNull()).alias("open")), "judged")
        release(cells, wide)
        found = found.union(finished(last.where("closed").select("doc", "low", "high"), "closed"))
        named = last.withColumn("id", F.xxhash64("doc", "begin"))
        alike = named.groupBy("key").agg(*ends).where("least <> greatest and any_open").select("key")
        marks = named.join(alike, "key").select("doc", "place", "low", "high", F.col("open").cast("int").alias("open"))
        spans, cell = None, max(cell // 5, 1)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400,
                    gram: int | None = None, cell: int | None = None) -> DataFrame:
    """``key``, kept (binary, what remains of the text's bytes), kept_text (the same without parts of
    signs), n_bytes, n_removed and n_spans (maximal removed runs) for each row of ``docs``."""
    gram = gram or max(length // 4, 1)
    cell = cell or max(length // 16, 1)
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    narrow = narrow.withColumn("doc", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = narrow.where(F.octet_length("text") >= length).select("doc", "key", "text")
    again = finished(texts.groupBy("doc").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1"), "copies")
    spans = repeated_starts(texts, again, length, gram, cell).groupBy("doc").agg(
        F.collect_list(F.struct("low", "high")).alias("starts"))
    found = finished(again.join(spans, "doc", "full"), "spans")
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in T.sub_batches(batch, "text"):
                begin, end = block.offsets[:-1], block.offsets[1:]
                change = np.zeros(len(block.data) + 1, np.int32)
                copied = rows.column("n").is_valid().to_numpy(zero_copy_only=False)
                np.add.at(change, begin[copied], 1)
                np.add.at(change, end[copied], -1)
                at, low, high = _listed(rows.column("starts"), "low", "high")
                base = np.repeat(begin, np.diff(at))
                np.add.at(change, base + low, 1)
                np.add.at(change, base + high + length, -1)
                gone = np.cumsum(change)[:-1] > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                first = begin[begin < end]
                opens[first] = gone[first]
                removed = T.per_text(gone, block.offsets)
                rest, place = block.data[~gone].tobytes(), np.concatenate([[0], np.cumsum(end - begin - removed)])
                kept = [rest[i:j] for i, j in zip(place[:-1].tolist(), place[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                     pa.array(end - begin), pa.array(removed), pa.array(T.per_text(opens, block.offsets))],
                    names=["key", "kept", "kept_text", "n_bytes", "n_removed", "n_spans"])

    return (narrow.join(found, "doc", "left").select("key", "text", "n", "starts")
            .mapInArrow(run, f"key {kind}, kept binary, kept_text string, n_bytes long, n_removed long, n_spans long")
            .withColumnRenamed("key", key))
