import re
from collections import Counter

import numpy as np

from airstats.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 10 or 100 * len(covered) > 20 * n}


def test_statistics(documents, texts):
    got = {r["key"]: r.asDict() for r in quality.rule_stats(documents).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        want = by_hand(text)
        assert {k: got[key][k] for k in want} == want, repr(text[:80])


def test_path_lengths_find_the_odd_one():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (2000, 4)), [[9, 9, 9, 9]]])
    score = quality.grow_forest(x, trees=50).score(x)
    assert score[-1] == score.max() and score[-1] > 0.7
    assert np.allclose(quality.grow_forest(x, trees=50).score(x), score)


def test_path_length_by_hand():
    forest = quality.Forest([(np.array([0, -1, -1]), np.array([0.5, 0, 0]), np.array([1, 0, 0]), np.array([0, 1.0, 3.0]))], 4)
    usual = float(quality._usual_path(4))
    assert np.allclose(forest.score(np.array([[0.0], [1.0]])), [2 ** (-1 / usual), 2 ** (-3 / usual)])


def test_verdicts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count()
    assert not got.kept[got.base_failed].any()
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() >= 0.99
    assert got[got.quality == 0].kept.mean() < 0.5


def test_without_labels_only_the_base_rules_reject(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(documents, none).toPandas()
    assert (got.kept == ~got.base_failed).all()


def test_empty_table(no_documents, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.judge(no_documents, labels).count() == 0


def test_bad_rows_that_pass_the_base_rules(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (got.quality == 0).sum() > 20
    assert got[got.quality == 0].kept.mean() < 0.2
    assert got[got.quality == 1].kept.mean() >= 0.999
