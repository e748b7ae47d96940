"""Conversations as training windows of a token budget.

Turns are ordered by turn number (null first), then role and text, so repeated numbers have one
order. Prefix sums of turn tokens place each turn in its conversation; windows are spans of whole
turns. Every turn is the target of one window. A window that is not a conversation's first begins
with the system turn and with the last turns before its span, up to a limit of tokens; these are
context and carry no loss, so a repeated assistant turn is learned once. A turn longer than the
budget is a window of its own.

The template is ``### role: text </turn>`` with a line end. Inside roles and texts a backslash and
the control strings are escaped, so that a reader gets back every turn exactly. Null roles and
texts count as empty, a null conversation key is a conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from airstats.storage import stored

OPEN, CLOSE = "### ", " </turn>\n"
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_ROLE_ESCAPES = _ESCAPES | {":": "\\c", "\n": "\\n"}
_BACK = {v: k for k, v in _ROLE_ESCAPES.items()}
_TEXT_RE = re.compile("|".join(map(re.escape, _ESCAPES)))
_ROLE_RE = re.compile("|".join(map(re.escape, _ROLE_ESCAPES)))
_BACK_RE = re.compile("|".join(map(re.escape, _BACK)))
_TURN_RE = re.compile(f"{re.escape(OPEN)}(.*?): (.*?){re.escape(CLOSE)}", re.S)

#: A long conversation is cut into stretches of so many budgets, which different tasks fill.
STRETCH = 32


def escaped(text: str) -> str:
    return _TEXT_RE.sub(lambda m: _ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return _BACK_RE.sub(lambda m: _BACK[m[0]], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text begins and ends."""
    head = f"{OPEN}{_ROLE_RE.sub(lambda m: _ROLE_ESCAPES[m[0]], role)}: "
    body = escaped(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parsed(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted window."""
    return [(unescaped(role), unescaped(body)) for role, body in _TURN_RE.findall(text)]


def word_tokens(text: Column) -> Column:
    """Words of a text and three for the template."""
    return F.regexp_count(text, F.lit(r"\S+")) + 3


def placed(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokens: Column | None) -> DataFrame:
    """Turns in order with their number and the tokens before them in the conversation.

    Rows are range-partitioned, so one conversation may fill many partitions. Sums within a
    partition are completed by what the partitions before hold of the same conversation; only a
    partition's first conversation can have such a part, so that table has a row per partition.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["conv", "turn", "role", "text"]
    rows = rows.withColumn("tokens", (tokens if tokens is not None else word_tokens(F.col("text"))).cast("long"))
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("row", F.monotonically_increasing_id())
                  .withColumn("part", F.shiftright("row", 33)), "turns")
    within = Window.partitionBy("part", "conv").orderBy("row")
    rows = (rows.withColumn("start", F.sum("tokens").over(within) - F.col("tokens"))
            .withColumn("number", F.row_number().over(within).cast("long")))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (rows.groupBy("part", "conv").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"))
             .withColumn("more", F.sum("n").over(earlier)).withColumn("many", F.sum("k").over(earlier))
             .where(F.col("many").isNotNull()).select("part", F.col("conv").alias("conv_2"), "more", "many"))
    rows = rows.join(F.broadcast(parts.withColumnRenamed("part", "part_2")),
                     (F.col("part") == F.col("part_2")) & F.col("conv").eqNullSafe(F.col("conv_2")), "left")
    return rows.select("conv", "role", "text", "tokens",
                       (F.col("start") + F.coalesce("more", F.lit(0))).alias("start"),
                       (F.col("number") + F.coalesce("many", F.lit(0))).alias("number"))


WINDOW_SCHEMA = ("stretch long, window int, first_turn long, n_context int, n_turns int, n_tokens long, "
                 "text string, loss array<struct<start:int,stop:int>>")


def windows(turns: DataFrame, budget: int = 2048, history: int = 512, conv: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text", tokens: Column | None = None,
            system: str = "system", target: str = "assistant") -> DataFrame:
    """Formatted windows of all conversations.

    ``loss`` has the ranges of characters of ``text`` that count for training; ``n_context`` of the
    window's ``n_turns`` turns are repeated context, the rest are its span, from turn
    ``first_turn`` (from 1) on. Windows are ordered by (stretch, window).
    """
    if not 0 <= history < budget:
        raise ValueError("history must be below the budget")
    rows = placed(turns, conv, turn, role, text, tokens)
    length = budget * STRETCH
    rows = rows.withColumn("own", F.floor(F.col("start") / length))
    # the last turns of a stretch are also history of the next one
    near = F.col("start") + F.col("tokens") > (F.col("own") + 1) * length - history
    spread = rows.withColumn("stretch", F.explode(F.when(near, F.array("own", F.col("own") + 1))
                                                  .otherwise(F.array("own"))))
    first = rows.where((F.col("number") == 1) & (F.col("role") == system))
    counts = rows.groupBy("conv").agg(F.max("own").alias("last")).where("last > 0").withColumnRenamed("conv", "conv_2")
    again = first.join(counts, F.col("conv").eqNullSafe(F.col("conv_2"))).withColumn(
        "stretch", F.explode(F.sequence(F.lit(1), F.col("last")))).drop("conv_2", "last")
    kind = turns.select(conv).schema[0].dataType.simpleString()
    grouped = (spread.unionByName(again).dropDuplicates(["conv", "stretch", "number"])
               .repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for (key, stretch), group in groupby(rows_of, key=lambda r: (r[0], r[1])):
            out += [(key, stretch, *w) for w in _spans(list(group), stretch, budget, history, system, target)]
            if len(out) >= 256:
                yield _as_batch(out, kind)
                out = []
        if out:
            yield _as_batch(out, kind)

    fields = ["conv", "stretch", "number", "own", "tokens", "role", "text"]
    return grouped.select(*fields).mapInArrow(run, f"conv {kind}, {WINDOW_SCHEMA}").withColumnRenamed("conv", conv)


_NAMES = ["conv", "stretch", "window", "first_turn", "n_context", "n_turns", "n_tokens", "text", "loss"]
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_TYPES = {"stretch": pa.int64(), "window": pa.int32(), "first_turn": pa.int64(), "n_context": pa.int32(),
          "n_turns": pa.int32(), "n_tokens": pa.int64(), "text": pa.string(), "loss": _LOSS}
_KEYS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _as_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"conv": _KEYS.get(kind)} | _TYPES
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(_NAMES, zip(*rows))], names=_NAMES)


def _spans(rows: list[tuple], stretch: int, budget: int, history: int, system: str, target: str) -> Iterator[tuple]:
    """Windows over the turns of one stretch; rows are (key, stretch, number, own, tokens, role, text)."""
    has_system = rows[0][2] == 1 and rows[0][5] == system
    begin = next((i for i, r in enumerate(rows) if r[3] == stretch), len(rows))
    count = 0
    while begin < len(rows):
        context: list[int] = []
        used = 0
        if rows[begin][2] > 1:
            if has_system:
                context, used = [0], rows[0][4]
            i, spent = begin - 1, 0
            while i >= has_system and spent + rows[i][4] <= history and rows[i][2] == rows[i + 1][2] - 1:
                spent += rows[i][4]
                context.insert(int(has_system), i)
                i -= 1
            # context gives way to a span that needs the room
            while context and used + spent + rows[begin][4] > budget:
                gone = context.pop(1 if has_system and len(context) > 1 else 0)
                if gone == 0 and has_system:
                    used = 0
                else:
                    spent -= rows[gone][4]
            used += spent
        end = begin
        while end < len(rows) and (end == begin or used + rows[end][4] <= budget):
            used += rows[end][4]
            end += 1
        text, loss, at = [], [], 0
        for i in [*context, *range(begin, end)]:
            formatted, low, high = turn_text(rows[i][5], rows[i][6])
            if i >= begin and rows[i][5] == target:
                loss.append({"start": at + low, "stop": at + high})
            text.append(formatted)
            at += len(formatted)
        yield (count, rows[begin][2], len(context), len(context) + end - begin, used, "".join(text), loss)
        begin, count = end, count + 1


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the windows hold of each conversation: ``conv``, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars.

    Context turns are passed over. A digest runs over a whole conversation in order, so its
    windows go through one task, one window at a time.
    """
    kind = formatted.select(conv).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = n_loss = n_chars = 0
            for _, n_context, text, spans in group:
                n_chars += len(text)
                for role, body in parsed(text)[n_context:]:
                    turns.update(f"{role}\n{body}\n".encode())
                    n_turns += 1
                for span in spans:
                    learned = unescaped(text[span["start"]:span["stop"]])
                    loss.update(learned.encode())
                    n_loss += len(learned)
            out.append((key, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [_KEYS.get(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return (formatted.select(F.col(conv).alias("conv"), "stretch", "window", "n_context", "text", "loss")
            .repartition("conv").sortWithinPartitions("conv", "stretch", "window")
            .select("conv", "n_context", "text", "loss")
            .mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv))
