"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id and digest into shards of about equal bytes, files roll when
their compressed size is reached, headers and digests are regenerated from the payloads, and
files appear under their final names only by renaming finished temporary ones; a manifest lists
what was committed.  The bounds of the ranges come from records chosen by hash, so reruns and
retried tasks write the same bytes.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.llm.common import materialise, scratch, spread_join

#: Bytes of payload in a shard, compressed bytes at which a file rolls, bytes of payload from which copies become revisits.
SHARD, ROLL, REVISIT = 32_000_000, 8_000_000, 1000
#: Shards at most, larger ones beyond, and records for each of them that are chosen by hash to find the bounds of the ranges.
SHARDS, CHOSEN = 20_000, 16
#: At most so many tasks read files.
TASKS = 10_000
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, crc32 long"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}:{digest}')}>"


def record_bytes(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int, original: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``original`` given) has the HTTP headers only."""
    target = "".join(c for c in url or "" if c > " ") or "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if original is not None else http + (payload or b"")
    head = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Page-ID": "" if page is None else str(page),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if target != url:  # what no header line can hold is kept beside it, as JSON
        head["WARC-Page-URL"] = json.dumps(url)
    if original is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(original, digest), "WARC-Refers-To-Page-ID": str(original)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while line := stream.readline().strip():
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        stream.readline(), stream.readline()
        yield head, block


def page_rows(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest (SHA-1), size of every row; null html is an empty payload."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))


def revisits(digests: DataFrame) -> DataFrame:
    """page_id, digest, original of the pages that revisit another: of equal payloads the largest page id is the response.

    ``digests`` is (page_id, digest, size), a written table; digests of very many pages are salted.
    """
    large = digests.where(F.col("size") >= REVISIT)
    last = large.groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n")
    return spread_join(large, last, ["digest", "size"], ["page_id"]).where("page_id is null or page_id <> original").select("page_id", "digest", "original").distinct()


def range_bounds(digests: DataFrame, shard: int) -> list[tuple[bool, int, str]]:
    """Keys (null last, page_id, digest) at which shards begin, so that each holds about ``shard`` bytes of payload.

    The sample is chosen by hash, so it is the same in every run; it has CHOSEN different keys for
    each shard on average, and there are at most SHARDS of these whatever the size.
    """
    n, size = digests.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = min(-(-size // shard), SHARDS)
    if wanted < 2:
        return []
    own = digests.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(max(1, n // (CHOSEN * wanted)))) == 0)
    held = own.groupBy("page_id", "digest").agg(F.sum("size").alias("size")).collect()
    bounds, filled, total = [], 0, sum(r["size"] for r in held)
    for null, page, digest, each in sorted((r["page_id"] is None, r["page_id"] or 0, r["digest"], r["size"]) for r in held):
        if filled * wanted >= (len(bounds) + 1) * total:
            bounds.append((null, page, digest))
        filled += each
    return bounds


def write_warc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", shard: int = SHARD, roll: int = ROLL) -> DataFrame:
    """Write a record for every row of ``pages`` under the URI ``path``; returns the manifest, also kept there as Parquet.

    Null html is an empty payload, a null url is about:blank in the archive and null again when
    read, and urls with blanks or control characters come back whole too; pages with a null id are
    written last and are responses unless a page with an id holds their payload; repeated rows give
    repeated records, of which those with the largest id are all responses; an empty table gives
    no file; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = page_rows(pages, id, url, html)
    digests = materialise(rows.select("page_id", "digest", "size"), "digests")
    bounds = range_bounds(digests, shard)

    @F.pandas_udf("int")
    def shard_of(page: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, (p is None, int(p or 0), d)) for p, d in zip(page, digest)], dtype="int32")

    # Each revisit's original is sorted right before the page's own rows, so that payloads are shuffled only once.
    notes = revisits(digests).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(None).cast("long").alias("size"), "original")
    rows = rows.withColumn("original", F.lit(None).cast("long")).unionByName(notes).withColumn("shard", shard_of(F.col("page_id").cast("string"), "digest"))
    order = ["shard", F.col("page_id").asc_nulls_last(), "digest", F.col("original").asc_nulls_last(), F.col("url").asc_nulls_first()]
    rows = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        done: list[tuple] = []
        now: int | None = None
        noted: tuple = ()
        seq, count, size, crc, out, temp = 0, 0, 0, 0, None, ""

        def close() -> None:
            nonlocal out, seq, count, size, crc
            if out is not None:
                out.close()
                name = f"part-{now:06d}-{seq:05d}.warc.gz"
                fs.move(temp, f"{root}/{name}")
                done.append((name, now, count, size, crc))
                out, count, size, crc, seq = None, 0, 0, 0, seq + 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["original"] is not None:
                    noted = (r["page_id"], r["digest"], r["original"])
                    continue
                original = noted[2] if noted[:2] == (r["page_id"], r["digest"]) else None
                if r["shard"] != now:
                    close()
                    now, seq = r["shard"], 0
                if out is None:
                    temp = f"{root}/_temporary-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp, compression=None)
                data = gzip.compress(record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], original), 6, mtime=0)
                out.write(data)
                count, size, crc = count + 1, size + len(data), zlib.crc32(data, crc)
                if size >= roll:
                    close()
        close()
        if done:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["file", "shard", "records", "bytes", "crc32"])

    manifest = f"{path}/manifest"
    rows.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files in the manifest, with checks of file and payload digests.

    Returns page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null
    for revisits): one row per record, repeated records and records of a null page_id included;
    urls are as written, null and empty ones too; an empty archive gives no row.  Files of no
    manifest, such as those of lost tasks, are not read.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        for batch in batches:
            for name, crc in zip(batch.column("file").to_pylist(), batch.column("crc32").to_pylist()):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{name}: its checksum is not the manifest's")
                rows = []
                for head, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(data))):
                    kind, page, to = head["WARC-Type"], head["WARC-Page-ID"], head.get("WARC-Refers-To-Page-ID")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    rows.append((int(page) if page else None, json.loads(head["WARC-Page-URL"]) if "WARC-Page-URL" in head else head["WARC-Target-URI"], kind, int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(to) if to else None, payload))
                names = [x.split()[0] for x in schema.split(", ")]
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", "crc32")
    return files.repartition(min(max(1, files.count()), TASKS), "file").mapInArrow(read, schema)


def archived_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and describe each record.

    page_id, payload_bytes, payload_digest, record_type, refers_to: one row per row of ``pages``,
    repeated rows and null ids included; a null html has 0 bytes; other columns are ignored; an
    empty table gives an empty one.
    """
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path, id, url, html)
    records = read_warc(pages.sparkSession, path).withColumn("own", F.sha1("payload"))
    bad = F.col("own").isNotNull() & (F.col("own") != F.col("payload_digest"))
    checked = F.when(bad, F.raise_error(F.lit("payload differs from its digest"))).otherwise(F.col("payload_digest"))
    return records.select(F.col("page_id").alias(id), "payload_bytes", checked.cast("string").alias("payload_digest"), "record_type", "refers_to")


