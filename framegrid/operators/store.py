"""Stored stages: the rows of a stage under a key of all that they depend on, written whole or not at all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, else the warehouse; for a local master without one a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not base:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="framegrid-stages-"))
        base = _own[0]
    return base.rstrip("/")


def stored(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows kept under ``key``, or those of ``make()``, then kept.

    Rows are written beside and renamed when they are complete; what an error leaves is removed,
    and of two writers of one key the first stays.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    final = path(f"{root}/{key}")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(final, "_SUCCESS")):
        part = path(f"{root}/_temporary-{key}-{uuid.uuid4().hex}")
        try:
            make().write.parquet(part.toString())
            if not fs.rename(part, final) and not fs.exists(path(final, "_SUCCESS")):
                raise OSError(f"{final.toString()} can't be made")
        finally:
            fs.delete(part, True)
    return spark.read.parquet(final.toString())


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: small tables that are used more than once are made once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
