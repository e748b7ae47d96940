import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from airstats.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text=None):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    """The topmost digest and the siblings of each node, level by level."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for path, at in zip(paths, places):
            path.append((at % 8, [d for i, d in enumerate(runs[at // 8]) if i != at % 8]))
        places = [at // 8 for at in places]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, sorted."""
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    climbs = {}
    for lang in langs:
        trees[lang].sort(key=lambda t: t[:3])
        climbs[lang] = climbed([t[2] for t in trees[lang]])
    root, crown = climbed([climbs[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, crown):
        for (_, _, leaf, row), path in zip(trees[lang], climbs[lang][1]):
            folded, path = leaf, path + above
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                folded = leaf_of(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]))
            for at, others in path:
                folded = sha("".join([*others[:at], folded, *others[at:]]))
            proof = sha("".join(d for _, others in path for d in others))
            out.append((row["doc_id"], leaf, climbs[lang][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in df.collect()), key=str)


def manifest_of(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    return collected(got), by_hand(spark.read.parquet(str(tmp_path / "documents.parquet")).collect())


def test_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = collected(queries.op13_merkle_manifest(spark, sf_dir))
    assert got == by_hand(rows) and {r[-1] for r in got} == {True, False}


def test_several_rounds_of_blocks(spark, tmp_path, monkeypatch):
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: whole(*a, **k, levels=1))
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"),
        F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 19).cast("string"))).alias("lang"),
        F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    got, want = manifest_of(spark, tmp_path, docs)
    assert got == want


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65])
def test_sizes_of_one_tree(spark, tmp_path, count):
    docs = spark.range(count).selectExpr("id AS doc_id", "'A' AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    got, want = manifest_of(spark, tmp_path, docs)
    assert got == want


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", None, "", 0), (1, "", None, "", 0), (2, "A" * 100_000, "é", "s", None),
            (2, "B", "é", None, 5), (None, "x", "", "s", 1), (3, "Ünï😀", "é", "s", -4)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, want = manifest_of(spark, tmp_path, docs)
    assert got == want


def test_empty_and_clashing_columns(spark, documents):
    clash = documents.withColumns({c: F.lit(1) for c in ("idx", "tree", "n", "digest", "kept", "block", "key")})
    found = merkle.manifest(clash, ["doc_id", "text"])
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof"] and found.count() == clash.count()
    assert found.where(merkle.proof_root(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    assert merkle.manifest(clash.limit(0), ["doc_id", "text"]).collect() == []
