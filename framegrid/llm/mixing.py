"""Mixing sources to target weights.

Tokens are summed by source, targets become repetition rates, and a document is emitted
floor(rate) times and once more with the rate's fraction as probability, drawn from a hash of
its id and the seed.  All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framegrid.llm.common import small, word_count

#: Weights given to the sources in code point order, repeated.
CYCLE = (3, 1, 2)


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources in code point order, null last, weigh ``cycle`` in turn and share ``share`` times all
    sizes; none gets more than ``most`` times its own size and what is over goes to the others by
    weight.  That is a water level: with sources ordered by the level at which they are full, the
    first ``k`` are full and the rest get level times weight, for the smallest k that fits.
    The windows run over one row per source, pre-aggregated.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in cycle)), (rank % len(cycle) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    w = sums.withColumn("weight", weight).withColumn("full", full).withColumn("level", F.col("full") / F.col("weight"))
    order = W.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumns({
        "taken": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "goal": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    w = w.withColumn("here", (F.col("goal") - F.col("taken")) / F.col("left"))
    water = F.min(F.when(F.col("here") <= F.col("level"), F.struct(F.col("level"), F.col("here"))))
    w = w.withColumn("water", F.coalesce(water.over(every)["here"], F.lit(float("inf"))))
    target = F.least("full", F.col("water") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return w.select("source", "source_size", target.alias("target"), F.least(rate, F.lit(float(most))).alias("rate"))


def hashed_unit(id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_rates(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **weights) -> DataFrame:
    """``docs`` with ``_fg_size``, ``_fg_source_size``, ``_fg_target`` and ``_fg_copies``.

    Sources are joined with null-safe equality: broadcast when their checked number is small,
    else by a shuffle whose hot source adaptive execution splits.
    """
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = source_targets(sized, **weights).select(F.col("source").alias("_fg_source"), F.col("source_size").alias("_fg_source_size"), F.col("target").alias("_fg_target"), F.col("rate").alias("_fg_rate"))
    near = sized.select("source").distinct()
    side = F.broadcast(targets) if small(near, 10_000) else targets
    out = docs.withColumn("_fg_size", word_count(F.col(text))).join(side, F.col(source).eqNullSafe(F.col("_fg_source")), "left")
    whole = F.floor("_fg_rate")
    extra = (hashed_unit(F.col(id), seed) < F.col("_fg_rate") - whole).cast("long")
    return out.withColumn("_fg_copies", (whole + extra).cast("long")).drop("_fg_source", "_fg_rate")


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **weights) -> DataFrame:
    """The mixed corpus: every row of ``docs``, with its columns, as often as its copies say.

    Rows with the same id get the same draw, so reruns and retries agree.  A null text has no
    words; a null source is a source of its own, ordered last; a source without words takes
    nothing; a null id draws as the empty string; an empty table gives an empty one.
    """
    rated = mix_rates(docs, id, text, source, seed, **weights)
    return rated.where("_fg_copies > 0").withColumn("_fg_copy", F.explode(F.sequence(F.lit(1), F.col("_fg_copies").cast("int")))).select(*docs.columns)
