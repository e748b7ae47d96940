import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from airstats.llm import idfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000, 300_000])
def test_round_trip(size):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.zipf(1.3, size), 50_000)
    ids[size // 2:] = ids[:size - size // 2]
    head, blocks, checks = idfile.pack(ids)
    assert (idfile.unpack(head, blocks, checks, size) == ids).all()


def test_predictable_ids_take_little_room():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 50_000, 50)
    head, blocks, checks = idfile.pack(np.tile(phrase, 4000))
    assert (idfile.unpack(head, blocks, checks, 200_000) == np.tile(phrase, 4000)).all()
    assert sum(map(len, blocks)) < 200_000 * 16 / 8 / 4
    same = idfile.pack(np.full(100_000, 7))
    assert (idfile.unpack(*same, 100_000) == 7).all()


def test_damage_is_noticed():
    ids = np.random.default_rng(2).integers(0, 900, 3000)
    head, blocks, checks = idfile.pack(ids)
    bad = bytearray(blocks[3])
    bad[len(bad) // 2] ^= 255
    with pytest.raises(ValueError, match="block 3"):
        idfile.unpack(head, [*blocks[:3], bytes(bad), *blocks[4:]], checks, 3000)


def test_blocks_are_independent():
    ids = np.random.default_rng(3).integers(0, 900, 2560)
    blocks = idfile.pack(ids)[1]
    other = ids.copy()
    other[256:512] = ids[256:512][::-1]
    again = idfile.pack(other)[1]
    assert blocks[0] == again[0] and blocks[2:] == again[2:] and blocks[1] != again[1]


def test_table(documents, texts, spark):
    special = spark.createDataFrame([(20_000, "a<|endoftext|>b"), (20_001, "don't  stop\n\n  x ")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(special)
    texts = texts | {20_000: "a<|endoftext|>b", 20_001: "don't  stop\n\n  x "}
    library = Tokenizer.from_file(PATH)
    stored = idfile.write(docs, PATH, 2)
    got = {r["doc_id"]: r for r in idfile.checksums(stored).collect()}
    whole = {r["doc_id"]: r["ids"] for r in idfile.documents(stored).collect()}
    assert got.keys() == texts.keys()
    start = 0
    for key in sorted(texts):
        ids = [*library.encode(texts[key], add_special_tokens=False).ids, 2]
        assert whole[key] == ids
        assert (got[key]["start"], got[key]["n_tokens"]) == (start, len(ids))
        assert got[key]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_many_records(documents, texts, monkeypatch):
    whole = {r["doc_id"]: tuple(r) for r in idfile.checksums(idfile.write(documents, PATH, 2)).collect()}
    monkeypatch.setattr(idfile, "RECORD", 500)
    small = idfile.write(documents, PATH, 2)
    assert small.count() > 8
    assert {r["doc_id"]: tuple(r) for r in idfile.checksums(small).collect()} == whole


def test_empty_table(no_documents):
    assert idfile.checksums(idfile.write(no_documents, PATH, 2)).count() == 0


def test_encoder_is_the_library_whatever_stands_where_texts_are_cut():
    parts = [*"ab z9.,'!-_\n\t\r\x00\x1c\x7fé中😀", "\u0085", " ", " ", "　", " ", "ʼ", "’", "​", "Ⅷ", "'s", "'re", " the",
             "I'll", "<|endoftext|>", "x" * 600]
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 25, 4000)] + ["", None, "中" * 300 + " b c"]
    library, encoder = Tokenizer.from_file(PATH), idfile.Encoder(PATH)
    for batch in (texts, texts[::-1]):
        for text, ids in zip(batch, encoder.encode(pa.array(batch, pa.string())), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_known_pieces_are_not_encoded_again(monkeypatch):
    encoder, asked = idfile.Encoder(PATH), []
    monkeypatch.setattr(encoder, "_ids", lambda texts, real=encoder._ids: asked.append(len(texts)) or real(texts))
    first = list(encoder.encode(pa.array(["one two, three"] * 500 + ["three one two"])))
    calls = sum(asked)
    assert calls < 6  # the pieces that begin with a blank go in one call, and none goes twice
    assert list(encoder.encode(pa.array(["one two, three"] * 500 + ["three one two"]))) == first and sum(asked) == calls
    monkeypatch.setattr(idfile, "REMEMBERED", 0)
    assert list(encoder.encode(pa.array(["one two, three"]))) == first[:1]
