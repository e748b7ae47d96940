import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from airstats.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "b", "th", "he", " ", "  ", "\n", "\t", "é", "㈱", "▁", "<s>", "<0x41>", "ing", "er", "😀", "\x00", "1",
         "00", "ﬁ", "the", " the", "。", "tion", "�", "aaaa", "-", "====", ".com", "s.", "(", "),"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(PATH)


def test_random_texts_as_the_library(library, model):
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text).tolist() == ids, repr(text)
        assert model.decode(np.array(ids)) == library.decode(ids), repr(text)


def test_random_ids_decode_as_the_library(library, model):
    rng = random.Random(5)
    for _ in range(4000):
        ids = [rng.choice([3 + rng.randint(0, 255), rng.randint(0, 31999), 28705, 0, 1, 2]) for _ in range(rng.randint(0, 9))]
        if 0 not in ids:  # how the unknown id is shown is a setting of the model
            assert model.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    small = pieces.Pieces(PATH)
    text = "the erentha of onthe the of ing thingen erentha"
    assert small.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_table(documents, texts, library):
    got = {r["doc_id"]: r for r in pieces.digests(documents, PATH).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_ids_and_back(documents, texts, library):
    ids = pieces.encoded(documents, PATH)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()}[0] == library.encode(texts[0], add_bos=True, add_eos=True)
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(ids, PATH).collect()}
    assert back == {k: library.decode(library.encode(t)) for k, t in texts.items()}


def test_empty_table(no_documents):
    assert pieces.digests(no_documents, PATH).count() == 0
