"""SentencePiece BPE by a table of merge-type prefixes.

A text prefix has exactly one encoding, so exactly one last token. A token that an automaton finds
at the end of the prefix is that last token if the encoding of the shorter prefix ends in a token
it is compatible with: encoding the two tokens' text gives the two tokens again. The table of last
tokens is filled from left to right in time linear in the text; the ids are read off backwards.

No piece has the space sign after another sign, and none has a sign the vocabulary lacks, so texts
fall into segments between which nothing merges; their encodings are remembered in a bounded table.
Null and empty texts have no pieces (only the begin and end ids, where asked for).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: Segments remembered by a worker before it starts anew.
REMEMBERED = 400_000


class Pieces:
    """Encoder and decoder for the BPE model in a SentencePiece file with identity normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        count = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(count)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(count)]
        self.byte_ids = [-1] * 256
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        #: What each id decodes to; None for ids that give nothing, bytes for byte pieces.
        self.plain: list[bytes] = [b""] * count
        self.text = text
        #: Signs of each piece; the last entry, of id -1, is that of a sign without a piece.
        self.sizes = [*map(len, text), 1]
        self.is_byte = np.zeros(count, bool)
        for i in range(count):
            if special[i]:
                continue
            if model.is_byte(i):
                value = int(text[i][3:5], 16)
                self.byte_ids[value], self.plain[i], self.is_byte[i] = i, bytes([value]), True
            else:
                self.ids[text[i]], self.rank[text[i]] = i, -model.get_score(i)
                self.plain[i] = text[i].replace(SPACE, " ").encode()
        self.parts: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            merged, halves = self._merge(piece)
            if merged == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, (self.ids[piece], len(piece)))
                if halves:
                    self.parts[piece] = halves
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.segments = _segments(self.ids)
        self.known: dict[str, bytes] = {}

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Encoding of a short text by merging, and the two halves of its last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], np.inf))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            last = (parts[best], parts[best + 1])
            parts[best:best + 2] = ["".join(last)]
        return parts, last

    def _compatible(self, left: str, right: str) -> bool:
        """Whether the text of the two tokens is encoded as these two tokens.

        It is, unless at some time a pair across their border is merged before the merges that the
        pair's two sides still take part in. Seen backwards from the whole tokens, the later of
        the two sides' own last merges is undone each time.
        """
        rank, limit = self.rank, np.inf
        while True:
            if rank.get(left + right, np.inf) < limit:
                return False
            left_parts, right_parts = self.parts.get(left), self.parts.get(right)
            of_left = rank[left] if left_parts else -np.inf
            of_right = rank[right] if right_parts else -np.inf
            if not left_parts and not right_parts:
                return True
            if of_left > of_right:  # of equal ranks the left one is merged first, so undone last
                limit, left = of_left, left_parts[1]
            else:
                limit, right = np.nextafter(of_right, np.inf), right_parts[0]

    def _tokens(self, text: str) -> list[int]:
        """Ids of a text between whose signs anything may merge; -1 for a sign without a piece."""
        last = [-1] * len(text)
        fits = self.fits
        for end, (piece, size) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            start = end - size
            if start >= 0 and last[start] >= 0:  # else the text's begin or a sign nothing merges with
                pair = last[start] << 32 | piece
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= 4 * REMEMBERED:
                        fits.clear()
                    fit = fits[pair] = self._compatible(self.text[last[start]], self.text[piece])
                if not fit:
                    continue
            last[end] = piece
        tokens, end, sizes = [], len(text) - 1, self.sizes
        while end >= 0:
            tokens.append(last[end])
            end -= sizes[last[end]]
        tokens.reverse()
        return tokens

    def _segment(self, segment: str) -> bytes:
        ids, at = self._tokens(segment), 0
        if min(ids) < 0:
            found, ids = ids, []
            for piece in found:
                if piece >= 0:
                    ids.append(piece)
                elif self.byte_ids[0] >= 0:
                    ids.extend(self.byte_ids[b] for b in segment[at].encode())
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
                at += self.sizes[piece]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> np.ndarray:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        known, packed = self.known, []
        if text:
            for segment in self.segments.findall(SPACE + text.replace(" ", SPACE)):
                ids = known.get(segment)
                if ids is None:
                    ids = self._segment(segment)
                    if len(segment) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[segment] = ids
                packed.append(ids)
        first = np.array([self.begin] * begin, "<u4").tobytes()
        final = np.array([self.end] * end, "<u4").tobytes()
        return np.frombuffer(b"".join([first, *packed, final]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one each."""
        plain, out = self.plain, []
        shown = [i for i in ids.tolist() if plain[i]]
        if not shown:
            return ""
        if not self.is_byte[ids].any():
            out = b"".join([plain[i] for i in shown]).decode()
            return out[1:] if out[0] == " " else out
        run = bytearray()
        for i in shown:
            if self.is_byte[i]:
                run += plain[i]
                continue
            if run:
                out.append(_bytes_text(bytes(run)))
                run.clear()
            out.append(plain[i].decode())
        out.append(_bytes_text(bytes(run)))
        text = "".join(out)
        return text[1:] if not self.is_byte[shown[0]] and text.startswith(" ") else text


def _segments(pieces: Iterable[str]) -> re.Pattern:
    """Parts of a text between which nothing merges: cut before space signs and at line ends.

    A vocabulary with a piece across such a place gets whole texts as segments.
    """
    if any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in pieces):
        return re.compile("(?s).+")
    return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def _bytes_text(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at:at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The model of a path, read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ids (array of int) with begin and end id, one row for each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_path)
        for batch in batches:
            ids = [pieces.encode(t.as_py()) for t in batch.column("text")]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view("<i4")))],
                names=["key", "ids"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key))


def decoded(rows: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text of the ids, one row for each row; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_path)
        for batch in batches:
            texts = [pieces.decode(_ids(x)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    return (rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
            .mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key))


def _ids(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy() if value.is_valid else np.zeros(0, np.int32)


def digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded.

    One pass: ids and texts stay in the worker that made them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column("text"):
                ids = pieces.encode(value.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("key", key))
