from collections import Counter

import numpy as np
import pytest

from airstats.llm import suffix


def by_hand(texts, length):
    data = {k: (t or "").encode() for k, t in texts.items()}
    times = Counter(d[i:i + length] for d in data.values() for i in range(len(d) - length + 1))
    out = {}
    for k, d in data.items():
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (bytes(np.frombuffer(d, np.uint8)[~gone]), len(d), int(gone.sum()), runs)
    return out


def run(spark, texts, **options):
    rows = [(k, t, "x", 0) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, i int")
    return {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"])
            for r in suffix.without_repeats(docs, **options).collect()}


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(6)

    def words(n):
        return "".join(rng.choice(list("abcdé "), n))

    shared = [words(n) for n in (12, 13, 20, 40, 150)]
    texts = {}
    for i in range(60):
        parts = [words(rng.integers(0, 30))]
        for _ in range(rng.integers(0, 3)):
            parts += [shared[rng.integers(len(shared))][rng.integers(0, 4):], words(rng.integers(0, 9))]
        texts[i] = "".join(parts)
    texts |= {100: texts[1] + "z" + texts[1], 101: "ab" * 60, 102: "a" * 50, 103: "ab" * 20, 104: None, 105: "",
              106: "short", 107: texts[2], 108: texts[2], 109: "x" + texts[2][1:], 110: "q" * 12, 111: shared[0]}
    return texts


def test_as_by_hand(spark, passages):
    got, want = run(spark, passages, length=12, gram=4, cell=3), by_hand(passages, 12)
    assert got == want
    assert 0 < sum(w[2] for w in want.values()) < sum(w[1] for w in want.values())


def test_longer_strings_and_other_cells(spark, passages):
    assert run(spark, passages, length=32) == by_hand(passages, 32)


def test_given_documents(spark, texts):
    assert run(spark, texts, length=60) == by_hand(texts, 60)


def test_anchors_of_equal_strings_are_alike():
    from airstats.llm import text as T
    import pyarrow as pa
    rng = np.random.default_rng(8)
    inner = "".join(rng.choice(list("abc"), 80))
    block = next(T.blocks(pa.array(["xx" + inner + "yyy", "z" * 31 + inner])))
    text, place, low, high = suffix.anchors(block, block.hashes(), 20, 5)
    owners = {}
    for t, p, a, b in zip(text, place, low, high):
        for s in range(a, b + 1):
            owners[(t, s - block.offsets[t])] = p - s
    assert all(owners[(0, 2 + s)] == owners[(1, 31 + s)] for s in range(61))
    assert len(owners) == (85 - 19) + (111 - 19)


def test_empty_table(no_documents):
    assert suffix.without_repeats(no_documents).count() == 0
