"""Shared helpers of the text operators: scratch tables, words, hashes, guarded and salted joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII blanks; ``bytes.split()`` cuts at the same ones.
BLANKS = r"[\x20\x09-\x0D]+"

#: At most this many ids of eight bytes are broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000

#: In ``spread_join`` a key is hot from so many rows on, or from this share of all rows where that is more.
HOT_ROWS, HOT_SHARE = 1000, 1 / 1000

_own_scratch: list[str] = []
_made: list[str] = []

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on every number."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder; where none is set, in the warehouse, or locally for a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not base:
        if not _own_scratch:
            _own_scratch.append("file://" + tempfile.mkdtemp(prefix="framegrid-"))
        base = _own_scratch[0]
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many scratch folders this process has named so far."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch folders named after the first ``since``, but for ``keep``, once nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in _made[since:]:
        if folder not in keep:
            at = path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[since:] = [x for x in _made[since:] if x in keep]


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    parts = F.size(F.split(F.coalesce(text, F.lit("")), BLANKS))
    head = F.coalesce(text, F.lit("")).rlike(r"\A[\x20\x09-\x0D]").cast("int")
    tail = F.coalesce(text, F.lit("")).rlike(r"[\x20\x09-\x0D]\z").cast("int")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, F.lit(0)).otherwise(parts - head - tail).cast("long")


def small(ids: DataFrame, most: int = BROADCAST_IDS) -> bool:
    """Whether a narrow table has at most ``most`` rows; stops counting beyond them."""
    return ids.limit(most + 1).count() <= most


def only_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df`` with (or with ``left_anti`` without) the rows whose key is in ``ids``.

    The ids are broadcast only when their checked number is small; else both sides are shuffled.
    """
    return df.join(F.broadcast(ids) if small(ids) else ids, key, how)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key, so that no key of many rows lands in one task.

    Rows by key are counted first, pre-aggregated.  Where no key is hot it is a plain join.  Else
    there are at most 1 / HOT_SHARE hot keys, so their counts are broadcast; their rows are dealt
    to salts by a hash of ``by`` and their row of ``side`` is copied to each salt.  ``rows`` is
    read twice and should be a written table.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    n, largest = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    most = max(HOT_ROWS, int(n * HOT_SHARE))
    if largest <= most:
        return rows.join(side, keys, how)
    hot = counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))
    hot = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)  # at most n / most rows
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("_salts")))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copied = side.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
