import hashlib
import re

import numpy as np
import pytest

from airstats.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def by_hand(text, items, window=10):
    words, hit, found = words_of(text), set(), set()
    for key, item in items:
        parts = words_of(item or "")
        size = min(window, len(parts))
        for s in range(len(parts) - size + 1) if parts else ():
            for i in range(len(words) - size + 1):
                if words[i:i + size] == parts[s:s + size]:
                    hit.update(range(i, i + size))
                    found.add(key)
    keys = sorted(map(str, found))
    return (len(words), len(hit), len(keys), hashlib.sha256(",".join(keys).encode()).hexdigest(), bool(hit))


@pytest.fixture(scope="module")
def items(spark, texts):
    long = " ".join(words_of(texts[0])[5:40])
    rows = [(1, long), (2, "Thnt"), (3, None), (4, "!!"), (5, "same line same"), (6, "of " * 12), (7, long.upper()), (10, "é")]
    return spark.createDataFrame(rows, "item_id long, text string")


def check(found, texts, items):
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.item_digest(found).collect()}
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        assert got[key] == by_hand(text, rows), repr(text[:80])


def test_by_hand(documents, texts, items):
    check(decontaminate.contamination(documents, items), texts, items)


def test_items_in_several_groups(documents, texts, items):
    check(decontaminate.contamination(documents, items, item_bytes=100), texts, items)


def test_given_benchmark(documents, texts, spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    check(decontaminate.contamination(documents, given), texts, given)


def test_no_items_and_no_documents(documents, no_documents, items, texts):
    found = decontaminate.contamination(documents, items.limit(0)).collect()
    assert len(found) == len(texts) and not any(r["hits"] or r["items"] for r in found)
    assert decontaminate.contamination(no_documents, items).count() == 0


def test_rarest_shingle_is_the_prefix():
    windows = decontaminate.Windows.of([1], ["a b c d e"], 10)
    frequency = np.array([5, 1, 3])
    shingle, window, offset = windows.prefixes(frequency)
    assert shingle.tolist() == [1] and window.tolist() == [0]
    assert offset.tolist() == windows.offset[windows.in_window == 1].tolist()
