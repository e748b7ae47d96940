import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from airstats.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(texts):
    n = Counter()
    for key, text in texts:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1:] == (b[at + 1:] if len(a) == len(b) else b[at:])


def by_hand(n):
    near = {w: [] for w in n}
    left = {}
    for w in n:  # words one edit apart share a word with one code point left out, or are that word
        for i in range(len(w)):
            left.setdefault(w[:i] + w[i + 1:], set()).add(w)
    for short, longer in left.items():
        together = list(longer | ({short} if short in n else set()))
        for i, a in enumerate(together):
            for b in together[:i]:
                if one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    forms = {}
    for w, others in near.items():
        best = min(set(others), key=lambda o: (-n[o], o), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n[w], len(set(near[w])), n[forms[w]] if forms[w] else None)
    return out


def collected(found):
    rows = found.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = counted([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = collected(spelling.variants(spelling.vocabulary(spelling.lettered(docs))))
    assert got == by_hand(n)
    assert any(form for form, *_ in got.values())


def test_hard_texts(documents, no_documents, spark):
    rows = [(None, "Abcdefgh abcdefgh abcdefg"), (None, "abcdefgh"), (1, "ÀÉßdefgh×÷ ÀÉßdefgh×÷ àéßdefgh"), (2, "z" * 200_000), (3, "z" * 200_000)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    n = counted([tuple(r) for r in docs.collect()])
    assert collected(spelling.variants(spelling.vocabulary(spelling.lettered(docs)))) == by_hand(n)
    assert spelling.variants(spelling.vocabulary(spelling.lettered(no_documents))).collect() == []


def chains():
    """Words of few letters, so that buckets are full and deletions ambiguous, and long ways to a root."""
    rng = np.random.default_rng(1)
    n = {"".join(rng.choice(list("ab"), rng.integers(7, 10))): int(10 ** rng.integers(0, 5)) + 1 for _ in range(500)}
    word = "a" * 30
    for i in range(8):
        n[word] = 2 * 10 ** i
        word = word[:-i - 1] + "b" + word[len(word) - i:]
    n |= {f"hotpref{a}{b}{c}": 2 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    return n


@pytest.mark.parametrize("size", [1 << 15, 200, 1])
def test_divided_buckets(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "BUCKET_SIZE", size)
    n = chains()
    got = collected(spelling.variants(table(spark, n)))
    assert got == by_hand(n)
    assert got["a" * 30][1] not in ("a" * 30, got["a" * 30][0])


def test_small_chunks(spark, monkeypatch):
    n = chains()
    rows = spelling._buckets(table(spark, n)).sort(*spelling._BUCKET, "part").toArrow().to_batches(max_chunksize=7)
    whole = sum(sum(b.column("n_near").to_pylist()) for b in spelling._search(iter(rows)))
    monkeypatch.setattr(spelling, "CHUNK_ROWS", 5)
    monkeypatch.setattr(spelling, "SEARCHES", 3)
    small = sum(sum(b.column("n_near").to_pylist()) for b in spelling._search(iter(rows)))
    assert whole == small == sum(near for _, _, _, near, _ in by_hand(n).values())


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=4), min_size=1), st.sets(st.text("abé", min_size=3, max_size=3)))
def test_near_rows(longer, shorter):
    import pyarrow as pa

    words = sorted(longer | shorter)
    points, lengths = spelling._code_points(pa.array(words))
    zeros = np.zeros(len(words), np.int64)
    query, row = spelling.near_rows(points, lengths, zeros, lengths == 4, zeros)
    got = sorted((words[q], words[r]) for q, r in zip(query, row))
    assert got == sorted((a, b) for a in longer for b in words if one_edit(a, b))


def test_extra_columns(documents):
    clash = documents.withColumns({c: F.lit(1) for c in ("word", "run", "h", "form", "m", "lo")})
    assert spelling.lettered(clash).columns == ["word"]
