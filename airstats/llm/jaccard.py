"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Texts with the same shingles form a class, and only classes are compared. A class meets others in
buckets: two sets that overlap enough share one of their first tokens in any fixed order (tokens
that many sets have come last), and all sets of like size with such a token go to the bucket of the
least of them. In a bucket, inverted lists answer T-occurrence searches after DivideSkip: the short lists of
a query's tokens are merged with a heap, the candidates' tokens in the long ones are looked up by
binary search, and sets that reach the overlap T are linked. Sets already connected with the query
are left out of its lists, so a bucket of many near copies costs little and gives few links.

Texts are sent only to buckets where they may have a link. Each class has a small parity bitmap of its
set, after the bitmap filter of Sandes, Teodoro and Melo; bits in which two bitmaps differ are a lower
bound of the tokens in which the sets differ. Sets that this bound keeps from all others of a bucket
are left out of it, which loses no link.

Large buckets are divided; every part has the bucket's first set. Sets that are in different
components afterwards are searched again, block by block, so no link between components is lost.

Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text (A-Z). A text with fewer words than a
shingle is one shingle of all its words. Null and empty texts and texts without words have no
shingles and are linked with nothing, not even with each other. Equal rows are linked with each
other and keep a result row each.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from airstats.llm import text as T
from airstats.llm.components import components
from airstats.llm.phases import finished

#: Sets of a bucket that are searched in one task's group; more are divided.
BUCKET = 400
#: Tokens that so many sets of a task have are proposed as frequent; at most FREQUENT are listed.
OFTEN, FREQUENT = 2, 1 << 20
#: Bits of the bitmap of asked texts; no result depends on it.
SIEVE = 1 << 26
#: Of the paper: how strongly the length of lists moves the border between short and long ones.
MU = 0.0085


def overlap(a: int, b: int) -> int:
    """Least intersection of sets of sizes a and b with 100 * intersection >= 80 * union."""
    return -(-4 * (a + b) // 9)


def block_sets(block: T.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, and their bounds."""
    block = T.Block(0, T.lower(block.data), block.offsets)
    words = T.find_words(block, T.SPACED)
    hashes = block.hashes()(words.starts, words.ends)
    found, at = T.shingles(hashes, words, size)
    grams, texts = [found], [words.text[at]]
    counts = words.counts()
    for width in range(1, size):
        short = np.flatnonzero(counts == width)
        if len(short):
            whole, at = T.shingles(hashes, words, width)
            first = np.searchsorted(at, words.bounds[short])
            grams.append(T.mixed(whole[first] + np.uint64(width)))
            texts.append(short)
    gram, text = np.concatenate(grams), np.concatenate(texts)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    gram, text = gram[new], text[new]
    return gram, np.searchsorted(text, np.arange(len(block) + 1))


def _summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:], dtype=np.uint64)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def set_classes(gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have equal numbers."""
    sums = _summed(gram, bounds), _summed(T.mixed(gram ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    size = np.diff(bounds).astype(np.uint64)
    return T.mixed(sums[0] ^ T.mixed(sums[1] ^ T.mixed(size + np.uint64(1)))).view(np.int64)


def _prefixes(gram: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of each set, frequent ones last, as many as similar sets can't all lack."""
    token = gram >> np.uint64(1)
    if len(frequent):
        at = np.searchsorted(frequent, token)
        at[at == len(frequent)] = 0
        token = token | ((frequent[at] == token).astype(np.uint64) << np.uint64(63))
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((token, text))
    length = sizes - (4 * sizes + 4) // 5 + 1
    kept = np.arange(len(token)) - bounds[text] < length[text]
    return token[order][kept], text[kept]


def _new_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of a task's texts, each once: shingles, bounds and numbers of their classes."""
    seen: set[int] = set()
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            gram, bounds = block_sets(block, size)
            classes = set_classes(gram, bounds)
            keep = []
            for i, c in enumerate(classes.tolist()):
                if c not in seen and bounds[i + 1] > bounds[i]:
                    seen.add(c)
                    keep.append(i)
            lengths = np.diff(bounds)[keep]
            parts = [gram[bounds[i]:bounds[i + 1]] for i in keep]
            yield (np.concatenate(parts) if parts else gram[:0],
                   np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), classes[keep])


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Tokens that come often among the first ones; they are put last.

    Any list gives the same links. This one holds what some task saw at least OFTEN times, at most
    FREQUENT tokens: a bound on what is broadcast, not on what is compared.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        token, times = none, np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            whole, back = np.unique(np.concatenate([token, *waiting]), return_inverse=True)
            weights = np.concatenate([times, np.ones(len(back) - len(times), np.int64)])
            return whole, np.bincount(back, weights, len(whole)).astype(np.int64)

        for gram, bounds, _ in _new_sets(batches, size):
            waiting.append(_prefixes(gram, bounds, none)[0])
            if sum(map(len, waiting)) > 1 << 20:
                token, times = merged()
                waiting = []
        token, times = merged()
        often = times >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(times[often])], names=["token", "n"])

    found = (texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas())
    return np.sort(found["token"].to_numpy(np.int64).view(np.uint64))


def _meetings(texts: DataFrame, size: int, frequent: np.ndarray) -> DataFrame:
    """``center`` and ``member``: classes that share a first token with the least such class."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, bounds, classes in _new_sets(batches, size):
            token, text = _prefixes(gram, bounds, shared.value)
            level = np.floor(np.log(np.maximum(np.diff(bounds), 1)) / np.log(1.2501)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(classes[text]), pa.array(level[text])],
                names=["token", "member", "level"])

    rows = texts.mapInArrow(run, "token long, member long, level int")
    of_token, of_level = Window.partitionBy("token"), Window.partitionBy("token", "level")
    # similar sets are at most one level of size apart, so each also meets those of the next level
    levels = F.explode(F.array("level", F.col("level") + 1)).alias("level")
    rare = (rows.where("token >= 0")
            .withColumns({"low": F.min("member").over(of_token), "high": F.max("member").over(of_token)})
            .where("low <> high").select("token", "member", levels)
            .withColumn("center", F.min("member").over(of_level)).where("center <> member").select("center", "member"))
    # frequent tokens have the sign bit; their groups may be hot, so rows are joined, not gathered
    often = finished(rows.where("token < 0").select("token", "member", levels), "frequent")
    least = (often.groupBy("token", "level").agg(F.min("member").alias("center"), F.max("member").alias("last"))
             .where("center <> last").drop("last"))
    hot = often.join(least, ["token", "level"]).where("center <> member").select("center", "member")
    return rare.union(hot).distinct()


class Lists:
    """Inverted lists over sets; sets are numbered by size, so lists are too."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = [len(s) for s in sets]
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.concatenate([new[1:], [len(token)]])
        shared = ends - new > 1
        self.lists = {t: owner[a:b] for t, a, b in
                      zip(token[new[shared]].tolist(), new[shared].tolist(), ends[shared].tolist())}

    def search(self, query: int, wanted: np.ndarray) -> Iterator[int]:
        """Sets flagged in ``wanted`` that overlap with set ``query`` enough."""
        size = self.sizes[query]
        low = bisect_left(self.sizes, -(-4 * size // 5))
        high = bisect_left(self.sizes, 5 * size // 4 + 1)
        if not wanted[low:high].any():
            return
        least = overlap(size, self.sizes[low])
        lists = []
        for token in self.sets[query].tolist():
            whole = self.lists.get(token)
            if whole is not None:
                part = whole[wanted[whole]]
                part = part[(part >= low) & (part < high)]
                if len(part):
                    lists.append(part.tolist())
        if len(lists) < least:
            return
        lists.sort(key=len)
        n_long = min(int(least / (MU * np.log2(len(lists[-1]) + 1) + 1)), least - 1)
        short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
        for found, times in groupby(heapq.merge(*short)):
            count = sum(1 for _ in times)
            need = overlap(size, self.sizes[found])
            if count < need - len(long):
                continue
            for i, one in enumerate(long):
                if count >= need or count + len(long) - i < need:
                    break
                at = bisect_left(one, found)
                count += at < len(one) and one[at] == found
            if count >= need:
                yield found


def bucket_links(sets: list[np.ndarray], labels: list[int], queries: list[bool]) -> list[tuple[int, int]]:
    """Links that connect all sets of a bucket which a search from a query set connects.

    Sets with equal labels count as connected. The result is a spanning set of links, as pairs of
    positions.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lists = Lists([sets[i] for i in order])
    names = {}
    part = np.array([names.setdefault(labels[i], len(names)) for i in order])
    links = []
    for q, i in enumerate(order):
        if not queries[i]:
            continue
        wanted = part != part[q]
        for found in list(lists.search(q, wanted)) if wanted.any() else ():
            if part[found] != part[q]:
                links.append((i, order[found]))
                part[part == part[found]] = part[q]
    return links


def sketches(gram: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A bitmap of each set: at least as many bits as tokens, a power of two; a bit is the parity of its tokens."""
    sizes = np.diff(bounds)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(bits)])
    place = np.repeat(starts[:-1], sizes) + (gram & np.repeat((bits - 1).astype(np.uint64), sizes)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=starts[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a // 8:b // 8] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def possible(sizes: np.ndarray, bitmaps: list[bytes], labels: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Flags the sets that may be linked with another one of the bucket, of another label, one of the two a query.

    Bitmaps are compared at the length of the shorter one; halves of a longer one are put together by xor.
    """
    words = np.array([len(b) // 8 for b in bitmaps])
    out = np.zeros(len(sizes), bool)
    for width in np.unique(words).tolist():
        those = np.flatnonzero(words >= width)
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(bitmaps[i], np.uint64).reshape(-1, width)) for i in those])
        for row in np.flatnonzero(words[those] == width).tolist():
            i = those[row]
            asked = (labels[those] != labels[i]) & (queries[those] | queries[i])
            asked &= (5 * sizes[those] >= 4 * sizes[i]) & (5 * sizes[i] >= 4 * sizes[those])
            both = sizes[those] + sizes[i]
            differ = np.bitwise_count(table ^ table[row]).sum(axis=1, dtype=np.int64)
            # 2 * overlap <= tokens of both less those in which they differ
            near = asked & (both - differ >= 2 * -(-4 * both // 9))
            if near.any():
                out[i] = True
                out[those[near]] = True
    return out


def _sieved(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows whose ``digest`` may be in ``digests``: all that are there, and of the others one in SIEVE by each digest.

    A bitmap of SIEVE bits goes to every task, as words of 64 bits. So texts that nothing asks for are not shuffled,
    however many others are.
    """
    words = (digests.select(F.pmod("digest", F.lit(SIEVE)).alias("bit")).groupBy(F.expr("bit div 64").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")))
    bit = F.pmod("digest", F.lit(SIEVE))
    return (rows.withColumn("bit", bit).withColumn("word", F.expr("bit div 64")).join(F.broadcast(words), "word")
            .where("shiftright(bits, cast(bit % 64 as int)) & 1 = 1").select(*rows.columns))


def _possible_members(buckets: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``buckets`` (center, salt, member, label, query) that may be linked within their center and salt."""
    names, kind = ["center", "salt", "member", "label", "query"], "center long, salt int, member long, label long, query boolean"

    def kept(table: pa.Table) -> pa.Table:
        sizes, labels, queries = (table.column(c).to_numpy() for c in ("n", "label", "query"))
        found = possible(sizes, table.column("bitmap").to_pylist(), labels, queries)
        return table.select(names).filter(pa.array(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            center, salt = (rest.column(c).to_numpy() for c in ("center", "salt"))
            ends = [0, *(np.flatnonzero((np.diff(center) != 0) | (np.diff(salt) != 0)) + 1).tolist()]
            for low, high in zip(ends, ends[1:]):
                if high - low > 1:
                    yield from kept(rest.slice(low, high - low)).to_batches()
            rest = rest.slice(ends[-1])
        if rest is not None and rest.num_rows > 1:
            yield from kept(rest).to_batches()

    return (buckets.join(bitmaps, F.col("member") == F.col("class")).select(*names, "n", "bitmap")
            .repartition("center", "salt").sortWithinPartitions("center", "salt").mapInArrow(run, kind))


def _searched(buckets: DataFrame, size: int) -> DataFrame:
    """Links (``a``, ``b``) within groups of equal ``center`` and ``salt``; rows also have a class,
    a label, whether they are queries, and the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part, block in T.sub_batches(batch, "text"):
                    gram, bounds = block_sets(block, size)
                    fields = [part.column(c).to_pylist() for c in ("center", "salt", "member", "label", "query")]
                    for i, row in enumerate(zip(*fields)):
                        yield (*row, gram[bounds[i]:bounds[i + 1]])

        out: list[tuple[int, int]] = []
        for _, group in groupby(rows(), key=lambda r: r[:2]):
            group = list(group)
            if len(group) > 1:
                _, _, classes, labels, queries, sets = zip(*group)
                out += [(classes[i], classes[j]) for i, j in bucket_links(list(sets), list(labels), list(queries))]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return (buckets.repartition("center", "salt").sortWithinPartitions("center", "salt", "member")
            .select("center", "salt", "member", "label", "query", "text").mapInArrow(run, "a long, b long"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                bucket: int = BUCKET) -> DataFrame:
    """``key``, n_shingles and component_id (the least key that links reach) for each row of ``docs``.

    Links are those of texts: rows of one key may have different texts, and rows without a key link
    as others do, but are no component_id as long as their component has any key.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"))
    texts = rows.select("text")
    kind = rows.schema["key"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in T.sub_batches(batch, "text"):
                gram, bounds = block_sets(block, shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("digest"), pa.array(np.diff(bounds).astype(np.int64)),
                     pa.array(set_classes(gram, bounds)), pa.array(sketches(gram, bounds), pa.binary())],
                    names=["key", "digest", "n_shingles", "class", "bitmap"])

    classes = finished(rows.mapInArrow(described, f"key {kind}, digest long, n_shingles long, class long, bitmap binary"), "classes")
    pairs = finished(_meetings(texts, shingle, _frequent(texts, shingle)), "meetings")

    # one text for each class that meets another: that of its least key and text, which several rows may have
    met = pairs.select(F.col("member").alias("class")).union(pairs.select("center")).distinct()
    equal = classes.join(met, "class").groupBy("class", "key", "digest").agg(
        F.count("*").alias("rows"), F.max(F.struct(F.col("n_shingles").alias("n"), "bitmap")).alias("set"))
    chosen = finished(equal.groupBy("class").agg(F.min(F.struct("key", "digest", "rows", "set")).alias("row"))
                      .select("class", "row.key", "row.digest", "row.rows", "row.set.*"), "chosen")
    repeated = not chosen.where("rows > 1").isEmpty()

    sizes = pairs.groupBy("center").agg(F.ceil(F.count("*") / bucket).cast("int").alias("parts"))
    whole = pairs.join(sizes, "center")
    members = (whole.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).drop("parts")
               .union(sizes.select("center", F.col("center").alias("member"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))))
    def with_texts(buckets: DataFrame) -> DataFrame:
        near = _possible_members(buckets, chosen.select("class", "n", "bitmap"))
        near = finished(near.join(chosen.select(F.col("class").alias("member"), "key", "digest"), "member"), "near")
        asked = near.select("center", "salt", "member", "label", "query", F.col("key").alias("of"), F.col("digest").alias("text_digest"))
        found = _sieved(rows, near).join(asked, F.col("key").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_digest")))
        found = found.select("center", "salt", "member", "label", "query", "text")
        return found.dropDuplicates(["center", "salt", "member"]) if repeated else found

    first = with_texts(members.select("center", F.col("salt").cast("int").alias("salt"), "member",
                                      F.col("member").alias("label"), F.lit(True).alias("query")))
    links = finished(_searched(first, shingle), "found")
    labels = components(links)

    # divided buckets: what is not in the bucket's largest component is searched against all of it
    large = whole.where("parts > 1").select("center", "member", "parts").union(
        sizes.where("parts > 1").select("center", F.col("center").alias("member"), "parts"))
    large = (large.join(labels, F.col("member") == F.col("node"), "left")
             .select("center", "member", "parts", F.coalesce("label", "member").alias("label")))
    large = finished(large, "large")
    counted = large.groupBy("center", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("center").agg(F.max(F.struct("n", "label"))["label"].alias("main"),
                                         F.count("*").alias("labels"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.where("labels > 1").withColumn("blocks", F.ceil((F.col("all") - F.col("most")) / bucket).cast("int"))
    left = large.join(main, "center")
    asked = left.where("label <> main").withColumn("block", F.pmod(F.xxhash64("member", F.lit(2)), F.col("blocks")).cast("int"))
    against = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(True))
    index = (left.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(False)))
    columns = ["center", "block", "part", "blocks", "member", "label", "query"]
    again = (against.select(columns).union(index.select(columns)).groupBy("center", "block", "part", "blocks", "member")
             .agg(F.first("label").alias("label"), F.max("query").alias("query"))
             .withColumn("salt", (F.col("part") * F.col("blocks") + F.col("block")).cast("int"))
             .select("center", "salt", "member", "label", "query"))
    more = finished(_searched(with_texts(again), shingle), "found")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = (classes.join(labels, F.col("class") == F.col("node"), "left")
             .withColumn("label", F.coalesce("label", "class")))
    least = named.where("n_shingles > 0").groupBy("label").agg(F.min("key").alias("component_id"))
    return (named.join(least, "label", "left")
            .select(F.col("key").alias(key), "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")))
