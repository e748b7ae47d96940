"""Token ids in files of range-coded blocks.

A file's records hold whole documents in the order of their keys. The ids of a record are cut into
blocks; each block begins with an empty model and has a CRC-32, so it is read without the others.
The coder mixes three predictions of the next id: that of the last two ids (order 2), that of the
last one (order 1), and the record's own id counts (order 0). How much each gets of the code range
follows from how often each was right in blocks' earlier positions of like confidence. All blocks of
a record are coded side by side, a position of each at a time, as numpy vectors.

Documents are encoded by the tokenizers library: a text's pre-tokens don't influence each other, so
texts are cut where one surely begins, and each different piece is encoded once and remembered, by a
64-bit hash, in a bounded table. Texts with a special token's string or with a piece of more than
LONGEST bytes go through the library whole. Null and empty texts have the end id alone. Equal keys are
ordered by the text's hash; every row is a document of its own. Records carry no row order but that
of the keys, and no task holds more than a record of ids besides its batch of texts.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from airstats.llm import text as T
from airstats.llm.phases import finished

#: Most ids of a block, and ids after which a record ends.
BLOCK, RECORD = 4096, 6 << 20
#: Pieces a worker remembers, and most bytes of one.
REMEMBERED, LONGEST = 600_000, 512

_SLOTS = 1024
#: No id has been seen in a slot: 65535 with no trust.
_EMPTY = 65535 << 2
#: Parts of the code range that say which prediction holds, and parts that an id from the counts lies in.
_KINDS, _COUNTED = 12, 20
_KIND_BITS, _COUNT_BITS = np.uint64(_KINDS), np.uint64(_COUNTED)
_WORD, _HALF = np.uint64(1) << np.uint64(32), np.uint64(32)


def _bytes_of(text: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(text.encode("latin-1"), np.uint8)] = True
    return table


_WORDLIKE = _bytes_of(string.ascii_letters + string.digits)
#: Bytes that end a token behind a letter or digit; an apostrophe may belong to what follows.
_MARKS = _bytes_of(string.punctuation.replace("'", ""))
_BLANK = _bytes_of(" \t\n\r")
#: Last bytes of characters that may be white space, ASCII controls among them.
_MAY_BE_BLANK = _bytes_of("".join(map(chr, [*range(0x21), 0x7F, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])))


def pieces(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of texts begin, and the bounds of texts in them.

    A pre-token of ``public_tokenizers.PATTERN`` begins at each, whatever stands before: at a blank behind
    anything else, and at a mark behind a letter or digit. Pieces end in no blank, so nothing looks beyond them.
    """
    data = block.data
    begins = np.zeros(len(data), bool)
    begins[1:] = (_BLANK[data[1:]] & ~_MAY_BE_BLANK[data[:-1]]) | (_MARKS[data[1:]] & _WORDLIKE[data[:-1]])
    edges = block.offsets[:-1]
    begins[edges[np.diff(block.offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, block.offsets)


class Encoder:
    """Ids of texts as the tokenizers library gives them, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level tokens are written with a character for each byte
        names = self.tokenizer.get_vocab()
        self.width = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.width[list(names.values())] = [len(name) for name in names]
        self._forget()

    def _forget(self) -> None:
        """``known``: hashes of pieces in ascending order; ``ids`` of them stand from ``starts`` on, ``sizes`` many."""
        self.known, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u2")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """Remember pieces that are not known yet."""
        found: list[list[int] | None] = [None] * len(texts)
        # behind a piece that ends in no blank, one that begins with a blank may stand in the same call
        joined = [i for i, t in enumerate(texts) if _BLANK[t[0]] and not _MAY_BE_BLANK[t[-1]]]
        for at in range(0, len(joined), 1000):
            some = joined[at:at + 1000]
            ids = self._ids([b"".join([texts[i] for i in some]).decode()])[0]
            ends = np.cumsum(self.width[ids])
            wanted = np.cumsum([len(texts[i]) for i in some])
            bounds = np.searchsorted(ends, wanted) + 1
            if len(ids) and bounds[-1] == len(ids) and (ends[bounds - 1] == wanted).all():
                for i, low, high in zip(some, [0, *bounds[:-1].tolist()], bounds.tolist()):
                    found[i] = ids[low:high]
        alone = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(alone), 10_000):
            some = alone[at:at + 10_000]
            for i, ids in zip(some, self._ids([texts[i].decode() for i in some])):
                found[i] = ids
        sizes = np.array([len(x) for x in found], np.int64)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), "<u2", int(sizes.sum()))])
        at = np.searchsorted(self.known, hashes)
        self.known, self.starts, self.sizes = (
            np.insert(old, at, new) for old, new in ((self.known, hashes), (self.starts, starts), (self.sizes, sizes)))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        for block in T.blocks(texts):
            yield from self._block(block)

    def _block(self, block: T.Block) -> Iterator[bytes]:
        if len(self.known) > REMEMBERED:
            self._forget()
        starts, bounds = pieces(block)
        ends = np.append(starts[1:], len(block.data))
        long = np.flatnonzero(ends - starts > LONGEST)
        hashes, first, back = np.unique(block.hashes()(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.append(self.known, np.uint64(0))[at] != hashes
        new[at == len(self.known)] = True
        new[back[long]] = False
        if new.any():
            self._learn(hashes[new], [block.data[starts[i]:ends[i]].tobytes() for i in first[new].tolist()])
            at = np.searchsorted(self.known, hashes)
        at[back[long]] = 0
        at = at[back]
        sizes = self.sizes[at] if len(self.known) else np.zeros(len(at), np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - sums[:-1], sizes) + np.arange(sums[-1])] if len(self.known) else self.ids
        whole = set(np.searchsorted(bounds, long, side="right") - 1)
        for i, (a, b) in enumerate(zip(sums[bounds[:-1]].tolist(), sums[bounds[1:]].tolist())):
            text = block.data[block.offsets[i]:block.offsets[i + 1]].tobytes()
            if i in whole or any(s in text for s in self.special):
                yield np.array(self._ids([text.decode()])[0], "<u2").tobytes()
            else:
                yield ids[a:b].tobytes()


class Model:
    """Predictions for one position of each block, side by side.

    A slot of ``seen`` holds the id that came last in a context and how far to trust it (0 to 3). For
    each pair of trusts, ``share`` holds how often order 2 was right, and how often only order 1.
    """

    def __init__(self, blocks: int, counts: np.ndarray):
        self.base, self.row = np.arange(blocks) * _SLOTS, np.arange(blocks) * 16
        self.seen = [np.full(blocks * _SLOTS, _EMPTY, np.int32) for _ in range(2)]
        two = np.repeat([0, 1 << 14, 1 << 15, 3 << 14], 4)
        one = np.tile([0, 1 << 14, 1 << 15, 3 << 14], 4) * (65536 - two) >> 16
        self.share = [np.tile(x, blocks) for x in (two, one)]
        self.last = np.zeros((2, blocks), np.int64)
        # every id that comes has a share of the counts' range
        present = np.flatnonzero(counts)
        share = np.zeros(len(counts), np.int64)
        room = (1 << _COUNTED) - len(present)
        share[present] = 1 + (counts[present].astype(float) / max(counts.sum(), 1) * room).astype(np.int64)
        if len(present):
            share[present[counts[present].argmax()]] += (1 << _COUNTED) - int(share.sum())
        self.width = share.astype(np.uint64)
        self.below = (np.cumsum(share) - share).astype(np.uint64)
        self.owner = np.repeat(np.arange(len(counts), dtype=np.uint16), share)

    def predict(self, k: int) -> None:
        mixed = self.last[0, :k] * 40503
        base = self.base[:k]
        self.at = [((mixed + self.last[1, :k] * 60493) >> 4 & _SLOTS - 1) + base, (mixed >> 4 & _SLOTS - 1) + base]
        self.was = [seen.take(at) for seen, at in zip(self.seen, self.at)]
        self.sure = [was & 3 for was in self.was]
        self.said = [was >> 2 for was in self.was]
        self.context = (self.sure[0] * 4 + self.sure[1]) + self.row[:k]
        self.shares = [share.take(self.context) for share in self.share]
        # each prediction keeps a little, the counts a sixteenth at least
        self.two = ((self.shares[0] * 3832 >> 16) + 4).view(np.uint64)
        self.both = ((self.shares[1] * 3832 >> 16) + 4).view(np.uint64) + self.two

    def narrow(self, ids: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """Narrow the code ranges to those of the ids, and learn from the ids."""
        two, both = self.two, self.both
        hit = [ids == said for said in self.said]
        hit[1] &= ~hit[0]
        other = np.flatnonzero(~(hit[0] | hit[1]))
        begin, end = np.where(hit[0], np.uint64(0), two), np.where(hit[0], two, both)
        begin[other], end[other] = both[other], np.uint64(1 << _KINDS)
        unit = width >> _KIND_BITS
        low += unit * begin
        width[:] = unit * (end - begin)
        new = ids[other]
        unit = width[other] >> _COUNT_BITS
        low[other] += unit * self.below[new]
        width[other] = unit * self.width[new]
        for share, was, right in zip(self.share, self.shares, hit):
            share[self.context] = was + ((right.astype(np.int64) << 16) - was >> 4)
        hit[1] = ids == self.said[1]
        fresh = (ids << 2 | 1).astype(np.int32)
        for seen, at, was, sure, right in zip(self.seen, self.at, self.was, self.sure, hit):
            seen[at] = np.where(right, was + (sure < 3), np.where(sure > 1, was & -4 | 1, fresh))
        k = len(ids)
        self.last[1, :k] = self.last[0, :k]
        self.last[0, :k] = ids

    def symbol(self, offset: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Ids whose code range holds the offsets."""
        unit = width >> _KIND_BITS
        value = np.minimum(offset // unit, np.uint64((1 << _KINDS) - 1))
        ids = np.where(value < self.two, self.said[0], self.said[1]).astype(np.int64)
        other = np.flatnonzero(value >= self.both)
        unit, both = unit[other], self.both[other]
        inner = (offset[other] - unit * both) // (unit * (np.uint64(1 << _KINDS) - both) >> _COUNT_BITS)
        ids[other] = self.owner[np.minimum(inner, np.uint64((1 << _COUNTED) - 1)).view(np.int64)]
        return ids


def _cut(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of blocks; the longer ones come first."""
    size = int(np.clip(len(ids) // 256, 256, BLOCK))
    starts = np.arange(0, len(ids), size)
    return starts, np.minimum(size, len(ids) - starts)


def pack(ids: np.ndarray) -> tuple[bytes, list[bytes], list[int]]:
    """Id counts, blocks and their checksums."""
    ids = ids.astype(np.int64)
    counts = np.bincount(ids)
    head = zlib.compress(counts.astype("<u4").tobytes(), 6)
    starts, lengths = _cut(ids)
    blocks = len(starts)
    if not blocks:
        return head, [], []
    model = Model(blocks, counts)
    low, width = np.zeros(blocks, np.uint64), np.full(blocks, ~np.uint64(0))
    out = np.zeros((blocks, int(lengths[0]) + 2), "<u4")
    place = np.zeros(blocks, np.int64)
    # ids of a position lie together
    steps = np.ascontiguousarray(np.pad(ids, (0, blocks * int(lengths[0]) - len(ids))).reshape(blocks, -1).T)
    for t, now in enumerate(steps):
        k = blocks if t < lengths[-1] else blocks - 1
        model.predict(k)
        model.narrow(now[:k], low[:k], width[:k])
        _shift(low[:k], width[:k], out, place)
    every = np.arange(blocks)
    for word in (low >> _HALF, low & _WORD - np.uint64(1)):
        out[every, place] = word
        place += 1
    return head, [out[i, :n].tobytes() for i, n in enumerate(place.tolist())], [
        zlib.crc32(ids[s:s + n].astype("<u4")) for s, n in zip(starts, lengths)]


def _shift(low: np.ndarray, width: np.ndarray, words: np.ndarray, place: np.ndarray, code: np.ndarray | None = None) -> None:
    """Widen ranges below a word: write their upper word, or read the next one.

    A range in which the upper word changes ends where it changes.
    """
    rows = np.flatnonzero(width < _WORD)
    if not len(rows):
        return
    a, b, at = low[rows], width[rows], place[rows]
    changes = (a ^ (a + b - np.uint64(1))) >= _WORD
    b = np.where(changes, _WORD - (a & _WORD - np.uint64(1)), b)
    if code is None:
        words[rows, at] = a >> _HALF
    else:
        code[rows] = code[rows] << _HALF | words[rows, at]
    place[rows] = at + 1
    low[rows], width[rows] = a << _HALF, b << _HALF


def unpack(head: bytes, blocks: list[bytes], checks: list[int], size: int) -> np.ndarray:
    """The ids of a record; a block whose checksum is wrong raises ValueError."""
    counts = np.frombuffer(zlib.decompress(head), "<u4").astype(np.int64)
    ids = np.zeros(size, np.int64)
    starts, lengths = _cut(ids)
    if not len(starts):
        return ids
    model = Model(len(starts), counts)
    data = np.zeros((len(blocks), int(lengths[0]) + 2), "<u4")
    for i, block in enumerate(blocks):
        words = np.frombuffer(block, "<u4", min(len(block) // 4, data.shape[1]))
        data[i, :len(words)] = words
    low, width = np.zeros(len(starts), np.uint64), np.full(len(starts), ~np.uint64(0))
    code = data[:, 0].astype(np.uint64) << _HALF | data[:, 1]
    place = np.full(len(starts), 2)
    steps = np.zeros((int(lengths[0]), len(starts)), np.int64)
    for t in range(int(lengths[0])):
        k = len(starts) if t < lengths[-1] else len(starts) - 1
        model.predict(k)
        now = model.symbol(code[:k] - low[:k], width[:k])
        np.minimum(now, len(counts) - 1, out=now)  # only a damaged block gets there
        np.minimum(place, data.shape[1] - 1, out=place)
        model.narrow(now, low[:k], width[:k])
        _shift(low[:k], width[:k], data, place, code)
        steps[t, :k] = now
    ids = steps.T.reshape(-1)[:size]
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        if zlib.crc32(ids[s:s + n].astype("<u4")) != checks[i]:
            raise ValueError(f"block {i}: its checksum is wrong")
    return ids


_LOADED: dict[str, Encoder] = {}
_RECORD = "part int, record int, keys array<{kind}>, lengths array<int>, head binary, blocks array<binary>, checks array<long>"


def records(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of all documents in ascending order of ``key``; (part, record) numbers them in order."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    ordered = (docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
               .select("key", "text", F.spark_partition_id().alias("part")))
    final = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _LOADED:
            _LOADED[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _LOADED[tokenizer_path]
        keys, ids, size, number, part = [], [], 0, 0, None

        def record() -> pa.RecordBatch:
            head, blocks, checks = pack(np.frombuffer(b"".join(ids), "<u2"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([keys], pa.list_(types.get(kind))),
                 pa.array([[len(x) // 2 for x in ids]], pa.list_(pa.int32())), pa.array([head], pa.binary()),
                 pa.array([blocks], pa.list_(pa.binary())), pa.array([checks], pa.list_(pa.int64()))],
                names=["part", "record", "keys", "lengths", "head", "blocks", "checks"])

        for batch in batches:
            for k, here, packed in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), encoder.encode(batch.column("text"))):
                part = here
                keys.append(k)
                ids.append(packed + final)
                size += len(packed) // 2 + 1
                if size >= RECORD:
                    yield record()
                    keys, ids, size, number = [], [], 0, number + 1
        if keys:
            yield record()

    return ordered.mapInArrow(run, _RECORD.format(kind=kind))


def write(docs: DataFrame, tokenizer_path: str, end_id: int, **columns) -> DataFrame:
    """The records written to the shared folder and opened again."""
    return finished(records(docs, tokenizer_path, end_id, **columns), "ids")


def documents(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start (ids before it), n_tokens and ids (array of int) of each document in records."""
    return _read(stored, key, "ids array<int>", lambda parts: pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))


def checksums(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids_crc32 of each document, from the ids read back."""
    return _read(stored, key, "ids_crc32 long", lambda parts: pa.array([zlib.crc32(p.astype("<u4")) for p in parts], pa.int64()))


def _read(stored: DataFrame, key: str, column: str, made) -> DataFrame:
    kind = stored.schema["keys"].dataType.elementType.simpleString()
    sizes = stored.select("part", "record", F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x).alias("n"))
    # ids before each part, then before each record of a part; there is a row for each part or record
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("part").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
              .select("part", "record", (F.col("earlier") + F.col("inner")).alias("start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = unpack(row["head"], row["blocks"], row["checks"], int(lengths.sum()))
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(parts), pa.int32()), pa.array([row["record"]] * len(parts), pa.int32()),
                     pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array(bounds[:-1]),
                     pa.array(lengths), made(parts)],
                    names=["part", "record", "key", "inner", "n_tokens", column.split()[0]])

    rows = stored.mapInArrow(run, f"part int, record int, key {kind}, inner long, n_tokens long, {column}")
    return rows.join(starts, ["part", "record"]).select(
        F.col("key").alias(key), (F.col("start") + F.col("inner")).alias("start"), "n_tokens", column.split()[0])


