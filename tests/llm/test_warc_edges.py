"""Archives: urls as they were, shards of equal bytes in id order, repeated rows, null ids, clashing columns."""

import pytest

from framegrid.llm import warc
from framegrid.llm.common import materialise, scratch

URLS = ["http://a/x", None, "", " ", "http://a/b c\t", "http://ä/ü\n\x01", "x" * 5000, '"quoted"', "about:blank"]


def test_urls_and_columns(spark):
    rows = [(i, u, f"page {i}", 1, "d") for i, u in enumerate(URLS)] + [(3, " ", "page 3", 1, "d"), (None, "n", None, 1, None), (None, "n", None, 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int, digest string")
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    got = sorted(((r.page_id, r.url, bytes(r.payload).decode(), r.record_type) for r in warc.read_warc(spark, path).collect()), key=str)
    assert got == sorted(((r[0], r[1], r[2] or "", "response") for r in rows), key=str)
    assert warc.archived_pages(pages).count() == len(rows)
    assert warc.archived_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [3000, 10**9])
def test_shards_are_ranges_of_equal_bytes(spark, shard):
    rows = [(10**12 * (i % 7) + 31 * i, f"u{i}", "x" * (i % 400) + str(i // 2)) for i in range(500)] + [(None, "n", f"{i} " * 50) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    path = scratch(spark, "warc")
    manifest = warc.write_warc(pages, path, shard=shard, roll=10**9).collect()
    assert sum(r.records for r in manifest) == len(rows)
    digests = materialise(warc.page_rows(pages).select("page_id", "digest", "size"), "digests")
    bounds = warc.range_bounds(digests, shard)
    size = sum(len(r[2]) for r in rows)
    assert bounds == sorted(bounds) and bounds == warc.range_bounds(digests.repartition(3), shard)
    n = max(1, -(-size // shard))
    assert len({r.shard for r in manifest}) == len(bounds) + 1 and 0.7 * n <= len(bounds) + 1 <= n
    records = {r.file: r for r in manifest}
    ends = []
    for name in sorted(records):
        import gzip
        with gzip.open(f"{path.removeprefix('file://')}/{name}") as f:
            held = [(h["WARC-Page-ID"] == "", int(h["WARC-Page-ID"] or 0)) for h, _ in warc.parse_records(f)]
        assert held == sorted(held)
        ends += [held[0], held[-1]]
    assert ends == sorted(ends)


def test_damaged_files_and_files_of_no_manifest(spark):
    import shutil
    from pathlib import Path

    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 40) for i in range(30)], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    names = [r.file for r in warc.write_warc(pages, path, shard=2000).collect()]
    root = Path(path.removeprefix("file://"))
    assert len(names) > 1
    shutil.copy(root / names[0], root / "lost-task.warc.gz")  # as of a task that was run twice
    assert warc.read_warc(spark, path).count() == 30
    data = bytearray((root / names[1]).read_bytes())
    data[len(data) // 2] ^= 1
    (root / names[1]).write_bytes(bytes(data))
    for crc in root.rglob(".*.crc"):  # the local file system's own checksums
        crc.unlink()
    with pytest.raises(Exception, match="its checksum is not the manifest's"):
        warc.read_warc(spark, path).count()
