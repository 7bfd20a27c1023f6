"""Frame files: ranges, choices, commits; GIFs against their frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrid.functions import gif as G
from framegrid.operators import gif
from framegrid.sources import frame_files
from framegrid.sources.frame_files import FrameReader, read_frames, write_frames

from test_packed import packed


def frames_of(n, h=5, w=7, seed=0, levels=256):
    rng = np.random.default_rng(seed)
    return [((rng.integers(0, levels, (h, w, 3)) * (256 // levels)).astype(np.uint8), rng.integers(0, 256, (h, w)).astype(np.uint8)) for _ in range(n)]


def test_a_long_file_is_many_tasks(spark, tmp_path):
    """Three gigabytes, mostly a hole in the file: only the frames asked for are read."""
    one = 1024 * 1024 * 3
    with open(tmp_path / "long-1024x1024.rgb", "wb") as f:
        f.truncate(1000 * one)
        f.seek(997 * one)
        f.write(b"\7" * one)
    df = read_frames(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == -(-1000 // ((64 << 20) // one)) > 40
    some = read_frames(spark, str(tmp_path), only=[0, 997, 5000])
    assert some.rdd.getNumPartitions() == 2
    got = some.select("frame_idx", F.substring("rgb", 1, 3).alias("s")).collect()
    assert {r.frame_idx: bytes(r.s) for r in got} == {0: b"\0\0\0", 997: b"\7\7\7"}
    assert read_frames(spark, str(tmp_path), clips=["long"], first=990).select("frame_idx").count() == 10
    assert read_frames(spark, str(tmp_path), clips=["other"]).count() == 0


def test_filters_hold_for_their_query_alone(spark, tmp_path):
    write_frames(packed(spark, frames_of(9)), str(tmp_path))
    df = read_frames(spark, str(tmp_path), bytes=300)
    assert sorted(r.frame_idx for r in df.where("frame_idx % 2 = 1 and frame_idx > 2 and frame_idx <= 7").select("frame_idx").collect()) == [3, 5, 7]
    assert df.where("frame_idx < 3 or clip_id = '9'").count() == 3 and df.where("h = 5 and frame_idx = 1").count() == 1 and df.count() == 9


def test_round_trip_and_manifest(spark, tmp_path):
    a, b = frames_of(6), frames_of(3, seed=1)
    df = packed(spark, a, 1).unionByName(packed(spark, b, 2)).repartition(4)
    write_frames(df, str(tmp_path / "out"))
    got = {(r.clip_id, r.frame_idx): (bytes(r.rgb), bytes(r.a)) for r in read_frames(spark, str(tmp_path / "out")).collect()}
    assert got == {(str(c), i): (rgb.tobytes(), x.tobytes()) for c, fs in ((1, a), (2, b)) for i, (rgb, x) in enumerate(fs)}
    manifest = [p.read_text().split() for p in (tmp_path / "out").glob("_manifest-*")]
    assert manifest == [["1-7x5.rgba", "2-7x5.rgba"]] and not list((tmp_path / "out").glob("_temporary*"))
    small = read_frames(spark, str(tmp_path / "out"), scale=0.5).collect()
    assert {(r.h, r.w) for r in small} == {(2, 4)}


@pytest.mark.parametrize("what, message", [("gap", "frame 2 where 1 is due"), ("size", "a frame of 4 x 3")])
def test_a_failed_task_leaves_nothing(spark, tmp_path, what, message):
    good = packed(spark, frames_of(4), 1)
    bad = packed(spark, frames_of(3, seed=2), 2).where("frame_idx <> 1") if what == "gap" else packed(spark, frames_of(1), 2).unionByName(packed(spark, frames_of(2, 3, 4), 2).where("frame_idx = 1"))
    with pytest.raises(Exception, match=message):
        write_frames(good.unionByName(bad), str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if not p.name.startswith(".")] == []


def test_reader_plans_ranges(tmp_path):
    (tmp_path / "c-2x1.rgb").write_bytes(bytes(6 * 10))
    r = FrameReader({"path": str(tmp_path), "bytes": "18"})
    assert [(p.first, p.last) for p in r.partitions()] == [(0, 2), (3, 5), (6, 8), (9, 9)]
    r.low, r.high, r.only = 4, 8, {1, 5, 8}
    assert [(p.first, p.last, sorted(p.only)) for p in r.partitions()] == [(4, 5, [5]), (6, 8, [8])]


def test_many_small_ranges_share_partitions(tmp_path, monkeypatch):
    data = np.random.default_rng(6).integers(0, 256, (50_000, 8), np.uint8)
    (tmp_path / "c-2x1.rgba").write_bytes(data.tobytes())
    (tmp_path / "d-2x1.rgba").write_bytes(data[:3000].tobytes())
    r = FrameReader({"path": str(tmp_path), "bytes": "16"})
    parts = r.partitions()
    assert 400 < len(parts) <= 502  # one for every two frames would be 26,500
    got = [row for p in parts for batch in r.read(p) for row in batch.to_pylist()]
    want = {"c": data, "d": data[:3000]}
    assert [(x["clip_id"], x["frame_idx"]) for x in got] == [(c, i) for c in dict.fromkeys(x["clip_id"] for x in got) for i in range(len(want[c]))] and len(got) == 53_000
    assert all(x["rgb"] == want[x["clip_id"]][x["frame_idx"]].reshape(2, 4)[:, :3].tobytes() and x["a"] == want[x["clip_id"]][x["frame_idx"]].reshape(2, 4)[:, 3].tobytes() for x in got[::97])
    assert max(batch.num_rows for p in parts for batch in r.read(p)) > 50  # not frame by frame
    monkeypatch.setattr(frame_files, "RANGE", 64)
    assert len(r.partitions()) == 53_000 * 8 // 64  # a partition never grows beyond it


def test_lzw_round_trips():
    rng = np.random.default_rng(3)
    for data in (b"", b"\0", b"aaaaaaaa", bytes(range(256)) * 3, rng.integers(0, 256, 40_000).astype(np.uint8).tobytes(), bytes(20_000), rng.integers(0, 3, 30_000).astype(np.uint8).tobytes()):
        assert G.unlzw(G.lzw(data), 8) == data
    for n in range(200, 900, 7):  # code sizes grow at the end
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert G.unlzw(G.lzw(data), 8) == data
    with pytest.raises(ValueError):
        G.unlzw(G.lzw(b"abcabc")[:-2], 8)


def test_gifs_are_held_frame_by_frame(spark, monkeypatch):
    rng = np.random.default_rng(7)
    frames = [rng.integers(0, 255, (4, 5)).astype(np.uint8) for _ in range(3)]
    data = G.head(5, 4, rng.integers(0, 256, (255, 3)).astype(np.uint8)) + b"".join(G.frame(f, 4) for f in frames)
    out = G.decoded(data)  # without its end the file is an error, but the frames before it have been given
    assert len([next(out) for _ in frames]) == 3
    with pytest.raises(ValueError):
        next(out)
    monkeypatch.setattr(gif, "HELD", 30)  # counts leave a task in parts and are summed
    rows = packed(spark, [(np.full((4, 5, 3), k % 2, np.uint8), np.full((4, 5), 255, np.uint8)) for k in range(9)])
    assert gif.HELD < 1 << 20 and sorted((r.colour, r.n) for r in gif.colour_counts(rows).collect()) == [(0, 100), (65793, 80)]


def test_median_cut():
    rng = np.random.default_rng(4)
    colours = rng.integers(0, 256, (3000, 3))
    weights = rng.integers(1, 9, 3000)
    palette = G.median_cut(colours, weights)
    assert 200 < len(palette) <= 255
    apart = np.sqrt(((colours[:, None] - palette[None].astype(int)) ** 2).sum(axis=2).min(axis=1))
    assert np.average(apart, weights=weights) < 25
    few = np.unique(colours[:200], axis=0)
    assert np.array_equal(G.median_cut(few, np.ones(len(few))), few)
    assert len(G.median_cut(np.zeros((0, 3), int), np.zeros(0))) == 0


@pytest.mark.parametrize("levels", [4, 256])
def test_gifs_decode_to_the_palettes_pixels(spark, tmp_path, levels):
    frames = frames_of(5, 9, 11, levels=levels)
    df = packed(spark, frames, 1).unionByName(packed(spark, [(rgb, np.zeros_like(a)) for rgb, a in frames[:2]], 2)).repartition(3)
    gif.write_gifs(df, str(tmp_path / "out"), fps=10)
    palette = {r.clip_id: np.frombuffer(bytes(r.palette), np.uint8).reshape(-1, 3) for r in gif.palettes(df).collect()}
    assert len(palette[1]) == (len(np.unique(np.concatenate([rgb[a >= 128] for rgb, a in frames]), axis=0)) if levels == 4 else len(palette[1])) <= 255
    for r in gif.read_gifs(spark, str(tmp_path / "out")).collect():
        rgb, a = frames[r.frame_idx]
        on = a >= 128 if r.clip_id == "1" else np.zeros_like(a, bool)
        near = palette[int(r.clip_id)][G.nearest(rgb, palette[int(r.clip_id)])]
        assert (np.frombuffer(bytes(r.a), np.uint8).reshape(9, 11) == np.where(on, 255, 0)).all()
        assert (np.frombuffer(bytes(r.rgb), np.uint8).reshape(9, 11, 3) == np.where(on[..., None], near, 0)).all()
        if levels == 4:
            assert (near[on] == rgb[on]).all()
    with pytest.raises(ValueError):
        G.decode((tmp_path / "out" / "1.gif").read_bytes()[:-9])


def test_supersampled_gifs_keep_flat_parts(spark, tmp_path):
    rgb, a = np.zeros((12, 16, 3), np.uint8), np.zeros((12, 16), np.uint8)
    rgb[:, :8], rgb[:, 8:], a[3:9, 2:14] = (200, 40, 40), (20, 90, 200), 255
    gif.write_supersampled_gifs(packed(spark, [(rgb, a)] * 2), str(tmp_path / "out"), factor=2)
    out = gif.read_gifs(spark, str(tmp_path / "out")).collect()
    assert len(out) == 2
    alpha, colours = np.frombuffer(bytes(out[0].a), np.uint8).reshape(12, 16), np.frombuffer(bytes(out[0].rgb), np.uint8).reshape(12, 16, 3)
    assert ((alpha > 0) == (a > 0)).all() and (np.abs(colours[4:8, 3:6].astype(int) - (200, 40, 40)) < 8).all()


def test_alpha_decided_at_a_larger_size(spark, tmp_path):
    from framegrid.functions.kernels import supersample_threshold

    frames = frames_of(2, 9, 11, levels=4)
    gif.write_ss_alpha_gifs(packed(spark, frames), str(tmp_path / "out"))
    for r in gif.read_gifs(spark, str(tmp_path / "out")).collect():
        want = supersample_threshold(frames[r.frame_idx][1])
        assert (np.frombuffer(bytes(r.a), np.uint8).reshape(9, 11) == want).all() and 0 < (want > 0).mean() < 1
