import re
from itertools import combinations

import numpy as np
import pytest

from airstats.llm import jaccard
from airstats.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def by_hand(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.fixture(scope="module")
def families():
    """Families of near copies with chains, so that not all of a family are alike."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    texts = {}
    for family in range(6):
        base = list(rng.choice(vocabulary, 60 + 10 * family))
        for i in range(30):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(len(words))] = rng.choice(vocabulary)
            if i % 7 == 0:
                base = words  # the family drifts
            texts[len(texts)] = " ".join(words)
    for i in range(40):  # a passage that many share
        texts[len(texts)] = " ".join([*rng.choice(vocabulary, 12), *vocabulary[:40], *rng.choice(vocabulary, 12)])
    texts[len(texts)] = texts[3].upper()
    texts[len(texts)] = "one two"
    texts[len(texts)] = "ONE\ttwo"
    texts[len(texts)] = "one two three"
    for empty in (None, "", " \n"):
        texts[len(texts)] = empty
    return texts


def run(spark, texts, **options):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, label int, center string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(docs, **options).collect()}


@pytest.mark.parametrize("bucket", [400, 4])
def test_families(spark, families, bucket):
    got, want = run(spark, families, bucket=bucket), by_hand(families)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 60


def test_frequent_tokens_change_nothing(spark, families, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    monkeypatch.setattr(jaccard, "FREQUENT", 500)
    assert run(spark, families) == by_hand(families)


def test_given_documents(spark, texts):
    assert run(spark, texts) == by_hand(texts)


def test_search_as_all_pairs():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = sorted((np.unique(rng.choice(pool, rng.integers(1, 40))) for _ in range(120)), key=len)
    lists = jaccard.Lists(sets)
    for q in range(len(sets)):
        wanted = np.arange(len(sets)) != q
        want = {i for i in range(len(sets)) if i != q and
                len(np.intersect1d(sets[q], sets[i])) >= jaccard.overlap(len(sets[q]), len(sets[i]))}
        assert set(lists.search(q, wanted)) == want


def _bitmaps(sets):
    return jaccard.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))


def test_bitmaps_leave_out_no_link_and_most_others():
    rng = np.random.default_rng(4)
    sets = []
    for size in (1, 2, 5, 40, 64, 65, 200, 700, 1500):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for lost in (0, 0.05, 0.1, 0.11, 0.2, 0.9):
            keep = base[rng.random(size) >= lost]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, size - len(keep)).astype(np.uint64)])))
    bitmaps, sizes = _bitmaps(sets), np.array([len(s) for s in sets])
    alone, both = np.arange(2), np.ones(2, bool)
    found = linked = 0
    for i, j in combinations(range(len(sets)), 2):
        got = jaccard.possible(sizes[[i, j]], [bitmaps[i], bitmaps[j]], alone, both)
        like = len(np.intersect1d(sets[i], sets[j])) >= jaccard.overlap(len(sets[i]), len(sets[j]))
        assert got[0] == got[1] and got[0] >= like
        found, linked = found + got[0], linked + like
    assert 20 < linked <= found < 2 * linked
    assert not jaccard.possible(sizes[[0, 0]], [bitmaps[0]] * 2, np.zeros(2), both).any()
    assert not jaccard.possible(sizes[[0, 0]], [bitmaps[0]] * 2, alone, ~both).any()


def test_texts_go_only_where_they_may_have_a_link(spark, monkeypatch):
    """Texts that share a first token and no more meet, but are not sent to a bucket."""
    searched = []
    whole = jaccard._searched
    monkeypatch.setattr(jaccard, "_searched", lambda buckets, size: searched.append(buckets.count()) or whole(buckets, size))
    shared = " ".join(f"s{i}" for i in range(40))
    texts = {k: " ".join(f"t{k}x{i}" for i in range(70)) + " " + shared for k in range(30)}
    texts[30] = texts[4] + " end"
    assert run(spark, texts) == by_hand(texts)
    assert searched[0] == 2


def test_overlap_is_the_least():
    for a in range(1, 60):
        for b in range(1, 60):
            t = jaccard.overlap(a, b)
            assert 100 * t >= 80 * (a + b - t) and 100 * (t - 1) < 80 * (a + b - t + 1)


def test_null_and_shared_keys(spark):
    """Texts link whatever their keys are."""
    said = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, said), (5, said + " more"), (7, other), (7, said + " less"), (9, other + " end"), (9, other + " end"), (None, "alone it is")]
    got = sorted(map(tuple, jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 56, 5), (5, 57, 5), (7, 56, 7), (7, 57, 5), (9, 57, 7), (9, 57, 7), (None, 1, None)], key=str)


def test_struct_keys(spark, families):
    rows = [((k % 7, k), t) for k, t in families.items()]
    docs = spark.createDataFrame(rows, "doc_id struct<a:long,b:long>, text string")
    got = {r["doc_id"]["b"]: r["component_id"]["b"] for r in jaccard.near_copies(docs).collect()}
    want = by_hand(families)
    groups = {}
    for k in got:
        groups.setdefault(want[k][1], []).append(k)
    assert all(got[k] == min(g, key=lambda x: (x % 7, x)) for g in groups.values() for k in g)


def test_empty_table(no_documents):
    assert jaccard.near_copies(no_documents).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[1000 + i] for i in range(30)}) == 1
    assert len({got[0], got[1000], got[2000]}) == 3


def test_texts_that_nothing_asks_for_are_not_shuffled(spark, monkeypatch):
    """The bitmap of asked texts keeps them, nulls among their keys included, and lets few others through."""
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("key"), F.col("id").cast("string").alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    asked = rows.where("cast(text as int) % 100 = 0").select("digest")
    want = {r["digest"] for r in asked.collect()}
    left = {r["digest"] for r in jaccard._sieved(rows, asked).collect()}
    assert want <= left and len(left) < len(want) + 20
    assert jaccard._sieved(rows, asked.where("digest is null")).isEmpty()
    monkeypatch.setattr(jaccard, "SIEVE", 128)  # a full bitmap loses nothing
    assert jaccard._sieved(rows, asked).count() > 10_000 and want <= {r["digest"] for r in jaccard._sieved(rows, asked).collect()}


@pytest.mark.parametrize("sieve", [64, 1 << 26])
def test_links_do_not_depend_on_the_sieve(spark, families, monkeypatch, sieve):
    monkeypatch.setattr(jaccard, "SIEVE", sieve)
    docs = spark.createDataFrame([(None if k == 5 else k, t) for k, t in families.items()] * 2, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(docs).collect()}
    label = {k: c for k, (_, c) in by_hand(families).items()}
    size = {k: n for k, (n, _) in by_hand(families).items()}
    members = {}
    for k, c in label.items():
        members.setdefault(c, []).append(k)
    least = {c: min([k for k in ks if k != 5], default=None) for c, ks in members.items()}
    assert got == {(None if k == 5 else k, size[k], (None if k == 5 else k) if not size[k] else least[label[k]]) for k in families}
