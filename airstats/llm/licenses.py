"""License notices in documents, by an exact set-similarity join with templates.

A text block is a run of lines without a blank line between them, a token a pair of consecutive words in it. A
block meets a template if it has at least ``share`` of the template's distinct tokens (containment). The join:
tokens are ordered by how many blocks hold them, the rarest first. A block that lacks the first
``size - need + 1`` tokens of a template, its prefix, cannot have ``need`` of them, so only prefix tokens are
joined; a block with fewer than ``need`` tokens of any template is too short (length); and where the first
common token stands so late in the template or in the block that too few can follow, the pair is dropped
(position). Pairs left over are counted out in full.

Only tokens that a template holds can count, so blocks are cut down to these while they are read, by a bitmap
of fixed size over the templates' hashes; wrong hits of the bitmap go in the join with the tokens themselves.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Words and tokens are compared by 64-bit
hashes. Null and empty texts have no words and no labels; texts of any length are read whole; every document
row gives a result row, also those with equal or null keys. A template of fewer than two words has no token
and meets nothing, null labels of templates are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from airstats.llm import text as T
from airstats.storage import stored

# Phrases that count wherever they stand, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices of common licenses, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except"
                 " in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
            " that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
            " General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)

SHARE = 0.8
#: Bits of the map that tells which tokens a template may hold.
MAP_BITS = 22


def templates(spark: SparkSession) -> DataFrame:
    """The built-in templates: ``label`` and ``text``."""
    return spark.createDataFrame(TEMPLATES, "label string, text string")


def _lowered(block: T.Block) -> T.Block:
    return T.Block(block.first, T.lower(block.data), block.offsets)


def _parts(block: T.Block, words: T.Words) -> np.ndarray:
    """A number for the text block of each word: it rises with each text and each blank line."""
    blank = (block.data == 32) | (block.data == 9) | (block.data == 13)
    solid = np.flatnonzero(~blank)
    ends = np.zeros(len(block.data) + 1, np.int64)
    lines = block.data[solid] == 10
    ends[solid[1:][lines[1:] & lines[:-1]]] = 1
    number = np.cumsum(ends)[words.starts] + words.text
    return number


def _tokens(hashes: np.ndarray, words: T.Words, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and the word each begins at; none reaches over the end of a text block."""
    return T.shingles(hashes, T.Words(words.starts, words.ends, part, words.bounds), 2)


def _template_tokens(rows: DataFrame, label: str, text: str) -> DataFrame:
    """template, label, token: distinct tokens of each template."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, block in T.sub_batches(batch, "text"):
                block = _lowered(block)
                words = T.find_words(block, T.ALNUM)
                hashes = block.hashes()(words.starts, words.ends)
                token, at = _tokens(hashes, words, words.text)
                of = words.text[at]
                order = np.lexsort((token, of))
                token, of = token[order], of[order]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
                of = pa.array(of[new])
                yield pa.RecordBatch.from_arrays(
                    [slice_.column("template").take(of), slice_.column("label").take(of), pa.array(token[new].view(np.int64))],
                    names=["template", "label", "token"])

    numbered = stored(rows.where(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("template"), F.col(label).cast("string").alias("label"),
        F.col(text).alias("text")), "license-templates")
    return stored(numbered.mapInArrow(run, "template long, label string, token long"), "license-tokens")


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """Which leading bits of hashes tokens have: a map of fixed size, whatever their number."""
    place = F.shiftrightunsigned("token", 64 - MAP_BITS)
    words = tokens.groupBy(F.shiftright(place, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _phrase_hashes(phrases: Sequence[tuple[str, str]]) -> list[np.ndarray]:
    block = _lowered(T.Block(0, *T.text_bytes(pa.array([p for p, _ in phrases], pa.string()))))
    words = T.find_words(block, T.ALNUM)
    hashes = block.hashes()(words.starts, words.ends)
    return [hashes[low:high] for low, high in zip(words.bounds[:-1], words.bounds[1:])]


def _phrase_places(hashes: np.ndarray, words: T.Words, wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words at which phrases begin, and which phrases."""
    place, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, phrase in enumerate(wanted):
        at = np.flatnonzero(hashes[:max(len(hashes) - len(phrase) + 1, 0)] == phrase[0])
        for k in range(1, len(phrase)):
            at = at[(hashes[at + k] == phrase[k]) & (words.text[at + k] == words.text[at])]
        place.append(at)
        which.append(np.full(len(at), i))
    return np.concatenate(place), np.concatenate(which)


_BLOCKS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("tokens", pa.list_(pa.int64()))]))


def _read(docs: DataFrame, shared, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """For each row: key, n_words, n_base, first_word, last_word, base (labels), blocks that hold tokens of
    templates, each with its first and last word and those tokens."""
    kind = docs.schema["key"].dataType.simpleString()
    wanted, names = _phrase_hashes(phrases), [label for _, label in phrases]

    def rows_of(rows: pa.RecordBatch, block: T.Block, bitmap: np.ndarray) -> pa.RecordBatch:
        count = len(block)
        words = T.find_words(block, T.ALNUM)
        hashes = block.hashes()(words.starts, words.ends)
        place, which = _phrase_places(hashes, words, wanted)
        n_base = np.zeros(count, np.int64)
        low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, -1)
        base: list[set[str]] = [set() for _ in range(count)]
        of = words.text[place]
        np.add.at(n_base, of, 1)
        np.minimum.at(low, of, place - words.bounds[of])
        np.maximum.at(high, of, place - words.bounds[of])
        for t, w in zip(of.tolist(), which.tolist()):
            base[t].add(names[w])

        part = _parts(block, words)
        token, at = _tokens(hashes, words, part)
        bit = token >> np.uint64(64 - MAP_BITS)
        held = np.flatnonzero((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
        token, at = token[held], at[held]
        order = np.lexsort((token, part[at]))
        token, at = token[order], at[order]
        of = part[at]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
        token, at, of = token[new], at[new], of[new]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        text = words.text[at[begin]]
        firsts = np.searchsorted(part, of[begin]) - words.bounds[text]
        lasts = np.searchsorted(part, of[begin], side="right") - 1 - words.bounds[text]
        tokens = pa.ListArray.from_arrays(pa.array(np.append(begin, len(token)).astype(np.int32)), pa.array(token.view(np.int64)))
        structs = pa.StructArray.from_arrays([pa.array(firsts), pa.array(lasts), tokens], fields=list(_BLOCKS.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(count + 1)).astype(np.int32)), structs)
        none = n_base == 0
        return pa.RecordBatch.from_arrays(
            [rows.column("key"), pa.array(words.counts()), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
             pa.array([sorted(b) for b in base], pa.list_(pa.string())), lists.cast(_BLOCKS)],
            names=["key", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for rows, block in T.sub_batches(batch, "text"):
                yield rows_of(rows, _lowered(block), bitmap)

    return docs.mapInArrow(run, (
        f"key {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, "
        "blocks array<struct<first:long,last:long,tokens:array<long>>>"))


def _ordered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tokens of each group as an array in the global order, ``tokens`` of struct<n, token>."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))


def notices(blocks: DataFrame, tokens: DataFrame, share: float = SHARE) -> DataFrame:
    """row, block, label and containment of each pair of a text block and a template it meets.

    ``blocks`` has row, block and tokens (array), ``tokens`` has template, label and token.
    """
    held = blocks.select("row", "block", F.explode("tokens").alias("token"))
    counts = stored(
        tokens.select("token").distinct().join(held.groupBy("token").agg(F.count("*").alias("n")), "token", "left")
        .select("token", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "license-counts")
    # A template is one row's text, and so are its tokens.
    sized = _ordered(tokens.join(counts, "token"), ["template", "label"]).withColumns({
        "size": F.size("tokens"), "need": F.ceil(F.size("tokens") * F.lit(share) - 1e-9).cast("int")})
    sized = stored(sized, "license-sized")
    prefixes = stored(sized.select("template", "size", "need", F.posexplode(
        F.slice("tokens", F.lit(1), F.col("size") - F.col("need") + 1)).alias("at", "entry")).select(
        "template", "size", "need", "at", F.col("entry.token").alias("token")), "license-prefixes")
    found = stored(_ordered(held.join(counts, "token"), ["row", "block"]).withColumn("held", F.size("tokens")), "license-blocks")
    least = sized.agg(F.min("need")).scalar()
    entries = found.where(F.col("held") >= least).select("row", "block", "held", F.posexplode(
        F.slice("tokens", F.lit(1), F.col("held") - least + 1)).alias("place", "entry"))
    follow = F.least(F.col("size") - F.col("at"), F.col("held") - F.col("place"))
    pairs = (
        entries.select("row", "block", "held", "place", F.col("entry.token").alias("token")).join(prefixes, "token")
        .where((F.col("held") >= F.col("need")) & (follow >= F.col("need")))
        .select("row", "block", "template").distinct())
    only = lambda entry: entry["token"]
    common = F.size(F.array_intersect(F.transform("tokens", only), "wanted"))
    return (
        pairs.join(found.select("row", "block", "tokens"), ["row", "block"])
        .join(sized.select("template", "label", "size", "need", F.transform("tokens", only).alias("wanted")), "template")
        .withColumn("common", common).where("common >= need")
        .select("row", "block", "label", (F.col("common") / F.col("size")).alias("containment")))


def scanned(docs: DataFrame, wanted: DataFrame | None = None, key: str = "doc_id", text: str = "text",
            label: str = "label", template: str = "text", share: float = SHARE,
            phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """For each row of ``docs``: ``key``, n_words, n_base, first_word, last_word, base (labels of phrases),
    found (array of label, first and last word of the text block, containment) and score: 1 where a phrase
    stands, else the greatest containment of a template met, else 0.

    ``wanted`` holds templates as ``label`` and ``template`` text; the built-in ones if it is not given.
    """
    spark = docs.sparkSession
    tokens = _template_tokens(templates(spark) if wanted is None else wanted, label, template)
    shared = spark.sparkContext.broadcast(_bitmap(tokens))
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(_read(narrow, shared, phrases).withColumn("row", F.monotonically_increasing_id()), "license-rows")
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "of")).select("row", "block", "of.first", "of.last", "of.tokens")
    met = notices(blocks, tokens, share).join(blocks.select("row", "block", "first", "last"), ["row", "block"])
    met = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "first", "last", "containment"))).alias("found"))
    found = F.coalesce("found", F.array().cast("array<struct<label:string,first:bigint,last:bigint,containment:double>>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["containment"])), F.lit(0.0)))
    return rows.drop("blocks").join(met, "row", "left").withColumns({"found": found, "score": score}).drop("row").withColumnRenamed("key", key)


def label_texts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`scanned` with base_labels and labels as comma-joined texts."""
    both = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda f: f["label"]))))
    return found.select(key, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                        F.array_join(both, ",").alias("labels"), "score")
