"""Chat formatting by quotation linking.

Lines that start with ">" are quotes, nested as deep as they have such marks.  Runs of lines of
equal depth are passages; they and their lines are normalised and hashed and joined to the lines,
paragraphs and whole messages of earlier turns.  Each message then follows the message that it
quotes, and its text loses the quotes that were found there; quotes of anything else stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import and_, itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framegrid.llm.common import materialise, small, spread_join

_MARK = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_LETTERS = re.compile(r"[^\W_]+")
#: Turns in one block: windows over a conversation run within blocks and then over one row per block.
BLOCK = 1024
UNITS = "array<struct<hash:long,weight:int,depth:int>>"


def normal(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


def quoted_lines(text: str) -> list[tuple[int, str, str]]:
    """(depth, line without its marks, line) of every line; depth 0 for lines that are no quote."""
    out = []
    for line in text.split("\n"):
        m = _MARK.match(line)
        out.append((m.group(1).count(">"), line[m.end() :], line) if m else (0, line, line))
    return out


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without its quotes, and the quoted passages as (depth, passage), innermost depth highest."""
    lines = quoted_lines(text or "")
    passages = [(d, "\n".join(bare for _, bare, _ in run)) for d, run in groupby(lines, itemgetter(0)) if d]
    return "\n".join(line for d, _, line in lines if not d).strip("\n") if passages else text or "", passages


def hash_of(piece: str) -> int | None:
    """Hash of a piece's letters and digits, lower-cased, one space for all between; None if it has none."""
    n = normal(piece)
    return xxhash.xxh3_64_intdigest(n.encode()) - 2**63 if n else None


def without(text: str, found: set[int]) -> str:
    """``text`` without the quoted passages, paragraphs and lines whose hashes are in ``found``.

    Blank quote lines go with the last other line of their passage.  Where nothing goes the text
    stays as it is, else line breaks at its ends go too.
    """
    kept, gone = [], False
    for d, run in groupby(quoted_lines(text), itemgetter(0)):
        run = list(run)
        left = [True] * len(run)
        if d and hash_of("\n".join(x for _, x, _ in run)) in found:
            left = [False] * len(run)
        elif d:
            at = 0
            for empty, part in groupby(run, lambda r: r[1] == ""):
                part = list(part)
                whole = not empty and hash_of("\n".join(x for _, x, _ in part)) in found
                for i, (_, x, _) in enumerate(part):
                    left[at + i] = not whole and hash_of(x) not in found
                at += len(part)
            if not any(keep and normal(x) for keep, (_, x, _) in zip(left, run)) and not all(left):
                left = [False] * len(run)
        gone = gone or not all(left)
        kept += [line for keep, (_, _, line) in zip(left, run) if keep]
    return "\n".join(kept).strip("\n") if gone else text


def _hashed(pieces: list[tuple[int, str]]) -> list[dict]:
    best: dict[tuple[int, int], int] = {}
    for depth, piece in pieces:
        if n := normal(piece):
            best[(xxhash.xxh3_64_intdigest(n.encode()) - 2**63, depth)] = len(n)
    return [{"hash": h, "weight": w, "depth": d} for (h, d), w in sorted(best.items())]


def _parts(text: str) -> list[str]:
    return list(dict.fromkeys([text, *text.split("\n\n"), *text.split("\n")]))


_UNITS = pa.list_(pa.struct([("hash", pa.int64()), ("weight", pa.int32()), ("depth", pa.int32())]))


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_hashed([(d, x) for d, p in parse_quotes(t)[1] for x in _parts(p)]) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(units, _UNITS)], names=["conv_id", "turn", "units"])


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_hashed([(0, x) for x in _parts(parse_quotes(t)[0])]) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(units, _UNITS)], names=["conv_id", "turn", "units"])


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the quotes found, and how many quoted passages they have and how deep."""
    for batch in batches:
        texts, counts, depths = [], [], []
        for x, f in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            passages = parse_quotes(x)[1] if x and ">" in x else []
            texts.append(x or "" if f is None else without(x or "", set(f)))
            counts.append(len(passages)), depths.append(max((d for d, _ in passages), default=0))
        made = {"n_quotes": pa.array(counts, pa.int64()), "quote_depth": pa.array(depths, pa.int64()), "text": pa.array(texts, pa.string())}
        names = ["conv_id", "turn", "role", "reply_to", "n_quotes", "quote_depth", "n_matched", "text"]
        yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)


def _before(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the greatest ``value`` among rows of the same keys in earlier turns; hot keys are dealt by blocks of turns."""
    held = rows.withColumn("_block", F.floor(F.col("turn") / BLOCK))
    tops = held.groupBy(*keys, "_block").agg(F.max(value).alias("_top"))
    over = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    names = [*keys, "_block"]
    tops = tops.select(*(F.col(k).alias(f"_k_{k}") for k in names), F.max("_top").over(over).alias("_earlier"))
    inside = W.partitionBy(*names).orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    held = held.withColumn("_inside", F.max(value).over(inside))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in names))
    return held.join(tops, on, "left").select(*rows.columns, F.coalesce("_inside", "_earlier").alias(out))


def link_quotes(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, reply_to, n_quotes, quote_depth, n_matched, text: one row per row, without the quotes found.

    ``reply_to`` is the earlier turn of the conversation that the message quotes: the one whose
    lines, paragraphs or whole text match most of its outermost quotes, counted in characters
    (ties: the latest); of several turns that said the same the latest counts.  Without a match
    it is the turn before, null for the first.  ``n_matched`` counts the quoted pieces found, at
    any depth; quotes of nothing said before stay in the text.  Turns are ordered by number; rows with a null turn come first and reply to
    nothing; a null conversation is one of its own; null texts are empty; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty one.
    """
    rows = chats.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    key = F.xxhash64(F.col("conv_id").isNull(), "conv_id").alias("_k")  # null conversations are one
    quoting = rows.where(F.col("turn").isNotNull() & F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "text")
    asked = quoting.mapInArrow(_quoted, f"conv_id long, turn long, units {UNITS}").select("conv_id", "turn", F.explode("units").alias("q")).select("conv_id", "turn", "q.*")
    asked = materialise(asked.distinct(), "quoted")
    wanted = asked.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h")).distinct()
    # Only conversations in which something is quoted are hashed.
    convs = materialise(asked.select(key).distinct(), "conversations")
    spoken = rows.where("turn is not null").select(key, "conv_id", "turn", "text")
    spoken = spoken.join(F.broadcast(convs), "_k", "left_semi") if small(convs) else spread_join(spoken, convs, ["_k"], ["turn"])
    said = spoken.select("conv_id", "turn", "text").mapInArrow(_said, f"conv_id long, turn long, units {UNITS}").select("conv_id", "turn", F.explode("units.hash").alias("hash")).distinct()
    said = said.join(wanted, said["conv_id"].eqNullSafe(F.col("_c")) & (said["hash"] == F.col("_h")), "left_semi")
    none = F.lit(None)
    both = said.select("conv_id", "hash", "turn", F.col("turn").alias("source"), none.cast("int").alias("weight"), none.cast("int").alias("depth"))
    both = both.unionByName(asked.select("conv_id", "hash", "turn", none.cast("long").alias("source"), "weight", "depth"))
    found = _before(both, ["conv_id", "hash"], "source", "origin").where("weight is not null and origin is not null")
    votes = found.groupBy("conv_id", "turn", "origin").agg(F.sum(F.when(F.col("depth") == 1, F.col("weight")).otherwise(0)).alias("v"), F.countDistinct("hash").alias("n"), F.collect_set("hash").alias("hashes"))
    best = votes.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).agg(F.max(F.struct("v", "origin"))["origin"].alias("quoted_turn"), F.sum("n").alias("n_matched"), F.flatten(F.collect_list("hashes")).alias("found"))  # pieces of one message

    turns = rows.select("conv_id", "turn").distinct().withColumn("value", F.col("turn"))
    prior = _before(turns, ["conv_id"], "value", "previous").select(F.col("conv_id").alias("_pc"), F.col("turn").alias("_pt"), "previous")
    out = rows.join(best, rows["conv_id"].eqNullSafe(F.col("_c")) & (rows["turn"] == F.col("_t")), "left")
    out = out.join(prior, out["conv_id"].eqNullSafe(F.col("_pc")) & (out["turn"] == F.col("_pt")), "left")
    out = out.select("conv_id", "turn", "role", F.coalesce("quoted_turn", "previous").alias("reply_to"), F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"), "text", "found")
    return out.mapInArrow(_own_words, "conv_id long, turn long, role string, reply_to long, n_quotes long, quote_depth long, n_matched long, text string")


def reply_threads(linked: DataFrame) -> DataFrame:
    """``linked`` with ``thread`` (the smallest turn it descends from), ``level``, ``position`` and ``formatted``.

    Levels are found by joining replies to their originals round by round; the number of rounds is
    the logarithm of the longest chain, since each round doubles the distance that is known.
    ``position`` counts a thread's turns from 0, so rows in the order of conv_id, thread, position
    are the reply-ordered conversations, every original before its replies; every message is
    formatted as a block of its own, so no conversation is gathered in one place.  Rows with a
    null turn have no thread, level or position; a null conversation is one of its own; repeated
    rows have equal positions; a null role is "unknown"; an empty table gives an empty one.
    """
    linked = materialise(linked, "linked")
    jumps = materialise(linked.where("turn is not null").select("conv_id", "turn", F.col("reply_to").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("level"), F.col("turn").alias("top")).distinct(), "jumps")
    while not (going := jumps.where("up is not null")).isEmpty():
        far = jumps.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("level").alias("_level"), F.col("top").alias("_top"))
        step = going.join(far, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        step = step.select("conv_id", "turn", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"), F.coalesce("_top", "top").alias("top"))
        jumps = materialise(jumps.where("up is null").unionByName(step), "jumps")
    turns = jumps.select("conv_id", "top", "turn", F.floor(F.col("turn") / BLOCK).alias("block"))
    sums = turns.groupBy(F.col("conv_id").alias("_c"), F.col("top").alias("_top"), F.col("block").alias("_block")).agg(F.count("*").alias("n"))
    earlier = W.partitionBy("_c", "_top").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_c", "_top", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "top", "block").orderBy("turn")) - 1
    placed = turns.withColumn("_in", inside).join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("top") == F.col("_top")) & (F.col("block") == F.col("_block")))
    placed = materialise(placed.select("conv_id", "turn", (F.col("_in") + F.col("_before")).cast("long").alias("position")), "positions")
    ends = jumps.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("top").alias("thread"), "level")
    ends = ends.join(placed, F.col("_c").eqNullSafe(placed["conv_id"]) & (F.col("_t") == placed["turn"])).select("_c", "_t", "thread", "level", "position")
    out = linked.join(ends, linked["conv_id"].eqNullSafe(F.col("_c")) & (linked["turn"] == F.col("_t")), "left").drop("_c", "_t")
    block = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return out.withColumn("formatted", block)
