"""A table of jobs in versions: every change is one new version, made only if nobody made it first.

A version names the folders whose rows make up the table: a whole snapshot and the changes since,
of which the newest row of a job counts.  A change is worked out on the newest version and
committed by creating the next one's entry, which fails where it exists; then it is worked out
again.  So of two claims of one job one wins, and a reader never sees half a change.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.operators.service import WAITS

#: Changes after which a version is written whole, and attempts at a change before it is given up.
WHOLE, ATTEMPTS = 16, 20


class JobError(ValueError):
    """A refused change, with its code."""

    def __init__(self, code: str, detail: str = ""):
        self.code = code
        super().__init__(f"{code}: {detail}" if detail else code)


class Conflict(RuntimeError):
    """Others changed the table first, each time."""


class JobTable:
    """Jobs as rows with job_id, status and created_at, and any other columns, below the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Versions

    def _entry(self, version: int) -> str:
        return f"{self.root}/_log/{version:020d}.json"

    def version(self) -> int:
        """The newest version; 0 before the first."""
        log = self._path(f"{self.root}/_log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max([0, *(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())])

    def _commit(self, version: int, folders: list[str]) -> bool:
        """Whether the version's entry is now ours: it is written beside and put in its place only if that is free."""
        self._fs.mkdirs(self._path(f"{self.root}/_log"))
        beside = f"{self.root}/_log/_{uuid.uuid4().hex}"
        out = self._fs.create(self._path(beside), False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename there would replace what exists
                local = [unquote(urlparse(p).path) if "://" in p or p.startswith("file:") else p for p in (beside, self._entry(version))]
                try:
                    os.link(*local)
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(self._path(self._entry(version))) and self._fs.rename(self._path(beside), self._path(self._entry(version)))
        finally:
            self._fs.delete(self._path(beside), False)

    def _folders(self, version: int) -> list[str]:
        if not version:
            return []
        return json.loads(self.spark.read.text(self._entry(version), wholetext=True).first()[0])["folders"]

    def read(self, version: int | None = None) -> DataFrame:
        """The jobs of a version, by default the newest; a table that was never written is an error."""
        folders = self._folders(self.version() if version is None else version)
        if not folders:
            raise JobError("E_JOB_NOT_FOUND", "the table has no version")
        parts = [self.spark.read.parquet(f).withColumn("_place", F.lit(k)) for k, f in enumerate(folders)]
        if len(parts) == 1:
            return parts[0].where("not _gone").drop("_place", "_gone")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        columns = [c for c in every.columns if c not in ("_place", "_gone", "job_id")]
        newest = every.groupBy("job_id").agg(F.max_by(F.struct("_gone", *columns), "_place").alias("r"))
        return newest.where("not r._gone").select("job_id", *(F.col("r")[c].alias(c) for c in columns))

    # Changes

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.root}/rows-{uuid.uuid4().hex}"
        (rows if "_gone" in rows.columns else rows.withColumn("_gone", F.lit(False))).write.parquet(folder)
        return folder

    def change(self, work: Callable[[DataFrame | None], DataFrame | None]) -> DataFrame | None:
        """Commit the rows that ``work`` makes of the newest version; returns them, or None where there was nothing to change.

        ``work`` gets the jobs (None before the first version) and gives the changed ones whole,
        those to be deleted with ``_gone``; it runs again when another change came first.
        """
        for _ in range(ATTEMPTS):
            version = self.version()
            made = work(self.read(version) if version else None)
            if made is None:
                return None
            folder = self._write(made)
            rows = self.spark.read.parquet(folder)
            if not rows.isEmpty():
                held = self._folders(version)
                folders = [*held, folder] if len(held) < WHOLE else [self._write(self._after(version, rows))]
                if not self._commit(version + 1, folders):
                    self._fs.delete(self._path(folder), True)
                    continue
                return rows.drop("_gone")
            self._fs.delete(self._path(folder), True)
            return None
        raise Conflict(f"{ATTEMPTS} attempts")

    def _after(self, version: int, rows: DataFrame) -> DataFrame:
        old = self.read(version).join(rows.select("job_id"), "job_id", "left_anti")
        return old.unionByName(rows.where("not _gone").drop("_gone"), allowMissingColumns=True)

    def create(self, jobs: DataFrame) -> None:
        """Add jobs; one whose id is there already is refused with all others."""

        def work(held: DataFrame | None) -> DataFrame:
            twice = None if held is None else held.join(jobs.select("job_id"), "job_id", "left_semi").select("job_id").first()
            if twice is not None:
                raise JobError("E_JOB_EXISTS", str(twice["job_id"]))
            return jobs

        self.change(work)

    def claim(self, job_id=None, most: int = 1, now=None) -> list:
        """Ids of the waiting jobs that are ours to run now, the oldest ``most`` or the one asked for; others' claims leave none for us."""

        def work(held: DataFrame | None) -> DataFrame | None:
            if held is None:
                return None
            waits = held.where(F.col("status").isin(*WAITS))
            ours = waits.where(F.col("job_id") == F.lit(job_id)) if job_id is not None else waits.orderBy("created_at", "job_id").limit(most)
            return ours.withColumns({"status": F.lit("running"), "started_at": F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()})

        made = self.change(work)
        return [] if made is None else [r["job_id"] for r in made.orderBy("created_at", "job_id").select("job_id").collect()]

    def set_status(self, job_id, status: str, of: tuple[str, ...]) -> bool:
        """Whether the job was in one of the statuses ``of`` and is now in ``status``."""

        def work(held: DataFrame | None) -> DataFrame | None:
            return None if held is None else held.where((F.col("job_id") == F.lit(job_id)) & F.col("status").isin(*of)).withColumn("status", F.lit(status))

        return self.change(work) is not None

    def cancel(self, job_id) -> bool:
        """Whether a job that still waited is cancelled now."""
        return self.set_status(job_id, "cancelled", WAITS)

    def delete(self, job_id) -> None:
        """Delete a job; one that runs, and one that isn't there, are refused."""

        def work(held: DataFrame | None) -> DataFrame:
            row = None if held is None else held.where(F.col("job_id") == F.lit(job_id)).first()
            if row is None:
                raise JobError("E_JOB_NOT_FOUND", str(job_id))
            if row["status"] == "running":
                raise JobError("E_JOB_RUNNING", "cancel it first")
            return held.where(F.col("job_id") == F.lit(job_id)).withColumn("_gone", F.lit(True))

        self.change(work)


def validated(uploads: DataFrame, code) -> tuple[DataFrame, DataFrame]:
    """(jobs, clips) of the uploads (job_id, clip_no, input, ...): a clip with a ``code`` has failed and loses its input.

    A job is queued if any of its clips is pending; else it has failed itself, with a code of its own.
    """
    clips = uploads.withColumn("code", code).withColumns({"status": F.when(F.col("code").isNull(), "pending").otherwise("failed"), "input": F.when(F.col("code").isNull(), F.col("input"))})
    jobs = clips.groupBy("job_id").agg(F.count_if(F.col("status") == "pending").alias("n_pending"), F.count("*").alias("n_clips"))
    queued = F.col("n_pending") > 0
    return jobs.select("job_id", F.when(queued, "queued").otherwise("failed").alias("status"), F.when(~queued, "E_INPUT_UNREADABLE").alias("code"), "n_pending", "n_clips"), clips
