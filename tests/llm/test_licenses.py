import re
from math import ceil

import pytest
from pyspark.sql import functions as F

from airstats.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def pairs_of(text):
    words = words_of(text)
    return set(zip(words, words[1:]))


def blocks_of(text):
    return re.split("\n[ \t\r]*(?=\n)", text)


def by_hand(text, templates=licenses.TEMPLATES, share=0.8):
    words = words_of(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                base.add(label)
    labels, best = set(base), 1.0 if places else 0.0
    for block in blocks_of(text):
        held = pairs_of(block)
        for label, template in templates:
            wanted = pairs_of(template or "")
            if wanted and len(wanted & held) >= ceil(len(wanted) * share - 1e-9):
                labels.add(label)
                best = max(best, len(wanted & held) / len(wanted))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), best)


def check(found, texts, **by):
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.label_texts(found).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        want = by_hand(text, **by)
        assert got[key][:-1] == want[:-1], repr(text[:200])
        assert got[key][-1] == pytest.approx(want[-1])
    return got


@pytest.fixture(scope="module")
def noted(spark, documents, texts):
    mit = licenses.TEMPLATES[1][1]
    bsd = licenses.TEMPLATES[4][1]
    rows = ["Under the MIT-License under the mit license", mit.replace(" ", "\n"), mit.replace(" of ", "\n\nof "), mit[:-40], mit[:60],
            f"{texts[0]}\n \t\n{mit}\r\n\r\n{bsd.upper()}", "all rights\n\nreserved", "All rights\nreserved", "cc by nc cc by nc",
            "apache license\n\nversion 2", "license mit the under", mit + " " + "word " * 30_000 + bsd, "All rights reserved. " * 50]
    extra = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    return documents.select("doc_id", "text").unionByName(extra)


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_by_hand(noted):
    got = check(licenses.scanned(noted), texts_of(noted))
    assert got[20_001][-2] == "mit" and got[20_002][-2] != "mit" and got[20_005][-2] == "bsd,mit"


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(licenses.scanned(docs), texts_of(docs))
    labels = {label for row in got.values() for label in row[-2].split(",")}
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3", "all-rights-reserved"} <= labels


def test_own_templates(spark, noted, texts):
    long = " ".join(words_of(texts[0])[:60])
    rows = [("a", long), ("b", None), ("c", "one"), ("d", "of of of"), ("e", "same line"), ("a", long.upper()), ("f", long + " and others")]
    wanted = spark.createDataFrame([*rows, (None, long)], "label string, text string")
    found = licenses.scanned(noted, wanted.withColumn("token", F.lit(1)), share=0.9)
    check(found, texts_of(noted), templates=rows, share=0.9)


def test_no_templates_and_no_documents(spark, noted, no_documents):
    none = spark.createDataFrame([], "label string, text string")
    check(licenses.scanned(noted, none), texts_of(noted), templates=())
    assert licenses.scanned(no_documents).collect() == []


def test_keys_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "All rights reserved"), (None, "All rights reserved"), (4, None)], "doc_id int, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("row", "block", "token", "label", "found", "n")})
    got = sorted((str(r["doc_id"]), r["labels"]) for r in licenses.label_texts(licenses.scanned(docs)).collect())
    assert got == [("4", ""), ("None", "all-rights-reserved"), ("None", "all-rights-reserved")]
