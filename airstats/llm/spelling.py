"""Spelling variants of a corpus's words, by dynamic programming over sorted word lists.

Two words are near if they differ by one inserted, deleted or replaced code point. A word is searched in a
sorted list by the edit matrix of both, of which one edit needs a band of two cells a row: as many code points
of either word, or one more of the searched one. A row depends on a prefix of the list's word only, so words
that follow each other reuse the rows of their longest common prefix, and a range of words whose shared prefix
already takes more than one edit is skipped as a whole. Rows are made depth by depth for all searches of a
batch at once: a range of words with a common prefix has one row a search.

Which words need to be compared follows from where the edit is. With the longer word of ``m`` code points cut
in half, all before the cut or all behind it is the same in both, so words of lengths ``m`` and ``m - 1`` with
one such half in common form a bucket, and only the other half is compared. Sizes of buckets are counted
before any row is moved. In one too large for a list the compared part is halved again and again; at one code
point a bucket has no more words than there are letters. So no bucket is cut short, and none is larger than a
task can hold.

Null and empty texts have no words, and texts of any length are taken whole. A null key counts as an empty one
in the hash that deletes a code point. Repeated rows count again.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from airstats.storage import stored

RUN = "[a-zÀ-ÿ]+"
#: Code points of all compared parts of a bucket; one with more is divided.
BUCKET_SIZE = 1 << 15
#: Words handled at once, and code points of their parts if each were as long as the longest.
CHUNK_ROWS, CHUNK_SIZE = 1 << 14, 1 << 21
#: Searches carried on at once.
SEARCHES = 1 << 12


def lettered(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31) -> DataFrame:
    """``word``: each run of letters of each text, of some the code point deleted that a hash of key and run names."""
    runs = F.regexp_extract_all(
        F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    h, place = F.col("h"), (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2, F.length("run")))
    hashed = rows.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    return hashed.select(F.when(h % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = 7, often: int = 2) -> DataFrame:
    """Words of at least ``least`` code points that occur ``often`` times, and how often (``n``)."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


# Buckets: words of lengths m and m - 1, equal but for the places lo to hi of the longer.

def _member(word: Column, m: Column, lo: Column, hi: Column) -> Column:
    end = F.length(word) - m + hi
    return F.struct(
        m.alias("m"), lo.alias("lo"), hi.alias("hi"),
        F.concat(F.substr(word, F.lit(1), lo), F.substr(word, end + 1, F.length(word))).alias("shared"),
        F.substr(word, lo + 1, end - lo).alias("part"))


def _halved(rows: DataFrame, m: Column, lo: Column, hi: Column) -> DataFrame:
    """Members of the buckets of both halves of the places ``lo`` to ``hi``."""
    mid, word = F.floor((lo + hi) / 2).cast("int"), F.col("word")
    members = F.filter(F.array(_member(word, m, lo, mid), _member(word, m, mid, hi)), lambda b: b["hi"] > b["lo"])
    return rows.select("word", "n", F.inline(members))


_BUCKET = ["m", "lo", "hi", "shared"]


def _buckets(words: DataFrame) -> DataFrame:
    """Words in buckets of limited size, those alone in one left out."""
    size = F.length("word")
    members = _halved(words, size, F.lit(0), size).unionByName(_halved(words, size + 1, F.lit(0), size + 1))
    done = None
    while True:
        members = stored(members, "spelling-members")
        longer = F.length("word") == F.col("m")
        sizes = members.groupBy(*_BUCKET).agg(F.count("*").alias("rows"), F.count_if(longer).alias("longer"))
        sizes = stored(sizes.where("rows > 1 and longer > 0").withColumn(
            "large", (F.col("hi") - F.col("lo") > 1) & (F.col("rows") * (F.col("hi") - F.col("lo")) > BUCKET_SIZE)
        ).drop("rows", "longer"), "spelling-sizes")
        fitting = members.join(sizes.where("not large"), _BUCKET, "left_semi")
        done = fitting if done is None else done.unionByName(fitting)
        large = sizes.where("large")
        if large.isEmpty():
            return done
        members = _halved(members.join(large, _BUCKET, "left_semi"), F.col("m"), F.col("lo"), F.col("hi"))


# Search within batches of whole buckets.

def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each text, 0 behind its end, and the lengths."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(texts), int(lengths.max(initial=0)) + 2), np.uint32)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


def _common(points: np.ndarray, lengths: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the one before; -1 for the first of a bucket."""
    lcp = np.full(len(points), -1)
    if len(points) > 1:
        same = points[1:] == points[:-1]
        same[:, -1] = False
        lcp[1:] = np.where(bucket[1:] == bucket[:-1],
                           np.minimum(np.argmin(same, axis=1), np.minimum(lengths[1:], lengths[:-1])), -1)
    return lcp


def near_rows(points: np.ndarray, lengths: np.ndarray, bucket: np.ndarray, longer: np.ndarray,
              beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of sorted buckets that are one edit apart: each pair of longer words both ways round, a
    longer and a shorter word with the longer one first.

    A shorter word may come about by deletion at several places of a longer one with a letter repeated; the pair
    belongs to the bucket with the last of them. ``beyond`` is the code point behind the part.
    """
    lcp = _common(points, lengths, bucket)
    rows = len(points)
    last = points[np.arange(rows), np.maximum(lengths - 1, 0)]
    goes_on = (last == beyond) & (beyond > 0)
    roots = np.flatnonzero(lcp < 0)
    root_of = roots[np.searchsorted(roots, np.arange(rows), side="right") - 1]
    depth = int(lengths.max(initial=0))
    # a range of words with a common prefix of d code points begins where fewer are shared with the row before
    edges = [np.append(np.flatnonzero(lcp < d), rows) for d in range(depth + 1)]
    starts = [e[:-1][lengths[e[:-1]] >= d] for d, e in enumerate(edges)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    queries = np.flatnonzero(longer)
    for low in range(0, len(queries), SEARCHES):
        query = queries[low:low + SEARCHES]
        node = root_of[query]
        even, ahead = np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
        for d in range(depth + 1):
            ends = lengths[node] == d
            whole = ends & longer[node] & (lengths[query] == d) & (even == 1)
            shorter = ends & ~longer[node] & (lengths[query] == d + 1) & (ahead == 1) & ~((even == 0) & goes_on[query])
            hit = whole | shorter
            found.append((query[hit], node[hit]))
            if d == depth:
                break
            # ranges of one more code point within each range
            end = edges[d][np.searchsorted(edges[d], node, side="right")]
            first = np.searchsorted(starts[d + 1], node)
            many = np.searchsorted(starts[d + 1], end) - first
            child = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            query, even, ahead = (np.repeat(x, many) for x in (query, even, ahead))
            node = starts[d + 1][child]
            here = points[node, d]
            even = even + (here != points[query, d])
            ahead = np.minimum(ahead + (here != points[query, d + 1]), even + 1)
            alive = np.flatnonzero((even <= 1) | (ahead <= 1))
            query, node, even, ahead = query[alive], node[alive], even[alive], ahead[alive]
    return np.concatenate([q for q, _ in found]), np.concatenate([r for _, r in found])


_FOUND = "word string, n_near long, n long, form string"


def _searched(chunk: pa.Table, bucket: np.ndarray) -> pa.RecordBatch:
    """For each word with near ones in its bucket their number and the most frequent of them."""
    words = np.array(chunk.column("word").to_pylist(), dtype=object)
    n = chunk.column("n").to_numpy()
    m, lo = chunk.column("m").to_numpy(), chunk.column("lo").to_numpy()
    points, lengths = _code_points(chunk.column("part").combine_chunks())
    longer = pc.utf8_length(chunk.column("word")).to_numpy() == m
    beyond = np.array([ord(s[at]) if at < len(s) else 0 for s, at in zip(chunk.column("shared").to_pylist(), lo.tolist())], np.uint32)
    query, row = near_rows(points, lengths, bucket, longer, beyond)
    back = ~longer[row]
    owner, near = np.concatenate([query, row[back]]), np.concatenate([row, query[back]])
    used = np.unique(near)
    rank = np.zeros(len(words), np.int64)
    rank[used[np.argsort(words[used], kind="stable")]] = np.arange(len(used))
    order = np.lexsort((rank[near], -n[near], owner))
    owner, near = owner[order], near[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))
    return pa.RecordBatch.from_arrays(
        [pa.array(words[owner[first]], pa.string()), pa.array(count, pa.int64()), pa.array(n[near[first]], pa.int64()),
         pa.array(words[near[first]], pa.string())], names=["word", "n_near", "n", "form"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Search sorted buckets, some whole ones at a time."""
    rest, size = None, 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        size = max(size, pc.max(pc.utf8_length(batch.column("part"))).as_py() or 0)
        if rest.num_rows >= CHUNK_ROWS or rest.num_rows * size >= CHUNK_SIZE:
            bucket = _numbered(rest)
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if whole:
                yield _searched(rest.slice(0, whole), bucket[:whole])
                rest, size = rest.slice(whole).combine_chunks(), 0
                size = pc.max(pc.utf8_length(rest.column("part"))).as_py() or 0
    if rest is not None and rest.num_rows:
        yield _searched(rest, _numbered(rest))


def _numbered(rows: pa.Table) -> np.ndarray:
    """Number of the bucket of each row, in order."""
    change = np.zeros(max(rows.num_rows - 1, 0), bool)
    for name in _BUCKET:
        values = rows.column(name).combine_chunks()
        change |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(change)]).astype(np.int64)


def near_words(words: DataFrame) -> DataFrame:
    """For each word of a vocabulary that has near ones: word, n_near, and near_word and near_n, the most
    frequent of them (of equally frequent ones the least) and how often it occurs."""
    rows = _buckets(words).repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "part")
    found = rows.mapInArrow(_search, _FOUND)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("near_word"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last form reached from each word that has a ``form``.

    Every round goes on from where the last one came, so their number is the logarithm of the longest way.
    """
    hops = stored(forms.select("word", F.col("form").alias("root")), "spelling-hops")
    while True:
        further = hops.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        hops = stored(hops.join(further, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-hops")
        if hops.where("moved").isEmpty():
            return hops.drop("moved")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """For each word of a vocabulary (``word`` and ``n``): word, form, root, n, n_near, form_n.

    The form is the most frequent near word, if it is at least ``times`` as frequent; a word without a form is
    its own root.
    """
    words = stored(words, "spelling-words")
    formed = F.col("near_n") >= times * F.col("n")
    found = stored(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("near_word")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
