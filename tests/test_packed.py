"""Packed kernels against plain loops, the fixed order of the stages, reading of job records, and refusals."""

import json

import numpy as np
import pytest

from framegrid.functions import flow as W
from framegrid.functions import packed as P
from framegrid.operators import boxes as B
from framegrid.operators import matte as M
from framegrid.operators import service as S


def test_spread_is_dilation_by_its_element():
    rng = np.random.default_rng(0)
    for rows in (P.square(1), P.square(2), P.ellipse(1), P.ellipse(2), P.ellipse(5), P.disc(1.6), P.disc(3.3), P.square(0)):
        for h, w in ((7, 9), (1, 5), (12, 3)):
            m = rng.random((h, w)) < 0.15
            want = np.zeros_like(m)
            for y in range(h):
                for x in range(w):
                    want[y, x] = any(m[y + dy, x + dx] for dy, half in rows for dx in range(-half, half + 1) if 0 <= y + dy < h and 0 <= x + dx < w)
            assert (P.spread(m, rows) == want).all() and (P.shrink(~m, rows) == ~want).all()
    assert P.ellipse(2) == [(-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)] and [n for _, n in P.disc(1.5)] == [1, 1, 1]


def test_topology_and_subject_on_a_drawn_frame():
    a = np.zeros((12, 12), np.uint8)
    a[2:9, 2:9] = 255
    a[5, 5] = 0
    a[10, 10:12] = 255
    a[9, 10] = 90
    out = M.topology(a, 0.05)
    assert out[5, 5] == 255 and out[10, 10] == 0
    rules = M.SUBJECT | {"rim": 1}
    assert M.main_subject(a, rules=rules)[10, 10] == 0 and M.main_subject(a, rules=rules)[9, 10] == 0 and M.main_subject(a, rules=rules)[5, 5] == 0
    box = {"x0": 9.0, "y0": 9.0, "x1": 12.0, "y1": 12.0}
    assert (M.main_subject(a, box, rules=rules) == a).all()
    person = np.zeros_like(a)
    person[3:6, 3:6] = 255
    assert M.main_subject(a, box, person.tobytes(), rules | {"grow": 1})[10, 10] == 0
    assert (M.main_subject(a, box, np.zeros_like(a).tobytes(), rules) == a).all()
    with pytest.raises(ValueError):
        M.trimap(a / 255, 1, a > 0, "odd")


def packed(spark, frames, clip=1):
    rows = [(clip, i, a.shape[0], a.shape[1], bytearray(rgb.tobytes()), bytearray(a.tobytes())) for i, (rgb, a) in enumerate(frames)]
    return spark.createDataFrame(rows, "clip_id int, frame_idx int, h int, w int, rgb binary, a binary")


def test_stages_in_their_order(spark):
    """Clear, collapse, steady, subject, fringe: each by a plain loop on what the one before left."""
    rng = np.random.default_rng(3)
    frames = []
    for i in range(9):
        a = np.zeros((16, 16), np.uint8)
        a[3:12, 2 + i % 3 : 9 + i % 3] = 255
        a[13:16, 12:16] = 255
        if i == 4:
            a[3:10] = 0
        rgb = rng.integers(0, 256, (16, 16, 3)).astype(np.uint8)
        rgb[13:16, 12:16] = 130
        frames.append((rgb, a))
    stats = spark.createDataFrame([(1, 128.0, 128.0, 10.0, 10.0)], "clip_id int, mu_u double, mu_v double, sd_u double, sd_v double")
    clear = M.CLEAR | {"area_link": 4, "area": 8, "core": 1, "sat": 60.0}
    near = lambda rgb, a, m: (a > 127) & (P.distance_from(rgb.astype(np.float64), m) < 0.4)
    bg = packed(spark, frames).selectExpr("*", "cast(array(130, 130, 130) as array<double>) as bg")
    out = {r.frame_idx: np.frombuffer(bytes(r.a), np.uint8).reshape(16, 16) for r in M.postprocess(bg, lambda rgb, m: 1.0 if m[14, 13] else 0.0, near, stats, clear, M.SUBJECT | {"rim": 1}, 1.0, levels=1, reach=1, radius=1, fine=False).collect()}
    alphas = [a.copy() for _, a in frames]
    for a in alphas:
        a[13:16, 12:16] = 0
    areas = [int((a > 127).sum()) for a in alphas]
    colours = [rgb for rgb, _ in frames]
    fixed = [(colours[i - 1], alphas[i - 1]) if 0 < i < 8 and areas[i] < 0.6 * areas[i - 1] and areas[i] < 0.6 * areas[i + 1] else (colours[i], alphas[i]) for i in range(9)]
    assert fixed[4][1] is alphas[3]
    for i, (rgb, a) in enumerate(fixed):
        x = a
        if i not in (0, 8):
            sides = [W.warp(fixed[j][1], W.flow(W.grey(rgb), W.grey(fixed[j][0]), 1, 1, 1, False)) for j in (i - 1, i + 1)]
            x = np.median(np.stack([a, *sides]), axis=0).astype(np.uint8)
        x = M.main_subject(x, rules=M.SUBJECT | {"rim": 1})
        d = P.distance_from(rgb.astype(float), {"mu_u": 128, "mu_v": 128, "sd_u": 10, "sd_v": 10})
        assert (out[i] == np.where((x > 127) & (d < 0.4), 0, x)).all(), i


def test_records_are_read_from_files(spark, tmp_path):
    for name, text in (("a", json.dumps({"id": "a", "status": "running", "clips": [{"status": "running", "outputs": {"gif": "x"}}, {"id": "z", "status": "done"}]})), ("b", '{"id": "b", "sta'), ("c", json.dumps({"id": "c", "status": "waiting_gpu", "clips": []})), ("d", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    got = sorted((r.job_id, r.status, r.code, r.clip_id, r.clip_status, r.primary) for r in S.read_records(spark, str(tmp_path)).collect())
    assert got == [("a", "failed", "E_SERVER_RESTART", "00", "failed", "x"), ("a", "failed", "E_SERVER_RESTART", "z", "done", None), ("c", "queued", None, None, None, None)]


def test_foreground_of_a_known_mixture():
    from framegrid.functions import foreground as G

    yy, xx = np.mgrid[:80, :96]
    alpha = np.clip((30 - np.hypot(yy - 40, xx - 48)) / 8 + 0.5, 0, 1)
    f = np.stack((0.7 + 0.1 * np.sin(xx / 20), 0.3 + 0 * xx, 0.4 + 0.1 * np.cos(yy / 20)), axis=2)
    back = np.array([0.2, 0.8, 0.3])
    image = alpha[..., None] * f + (1 - alpha[..., None]) * back
    band = (alpha > 0.2) & (alpha < 0.98)
    assert np.abs(G.foreground(image, alpha) - f)[band].mean() < 0.02 < np.abs(image - f)[band].mean()
    rgb, a = np.rint(image * 255).astype(np.uint8), np.rint(alpha * 255).astype(np.uint8)
    out = G.despill(rgb, a)
    assert (out[~((a / 255 > 0.02) & (a / 255 < 0.98))] == rgb[~((a / 255 > 0.02) & (a / 255 < 0.98))]).all() and (out != rgb).any()
    assert G.despill(rgb, np.zeros_like(a)) is rgb and G.despill(rgb, np.where(a > 127, 255, 0).astype(np.uint8)) is rgb


def test_raw_files(spark, tmp_path):
    from framegrid.sources.raw import read_raw

    x = np.arange(2 * 4 * 6 * 4, dtype=np.uint8).reshape(2, 4, 6, 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one-6x4.rgba").write_bytes(x.tobytes())
    (tmp_path / "in" / "two-6x4.rgb").write_bytes(np.ascontiguousarray(x[:1, ..., :3]).tobytes())
    got = {(r.clip_id, r.frame_idx): r for r in read_raw(spark, str(tmp_path)).collect()}
    assert set(got) == {("one", 0), ("one", 1), ("two", 0)} and bytes(got["one", 1].a) == np.ascontiguousarray(x[1, ..., 3]).tobytes()
    assert bytes(got["two", 0].rgb) == np.ascontiguousarray(x[0, ..., :3]).tobytes() and got["two", 0].a is None
    half = {(r.clip_id, r.frame_idx): r for r in read_raw(spark, str(tmp_path), 2).collect()}
    assert (half["one", 0].h, half["one", 0].w) == (2, 3)
    (tmp_path / "in" / "bad-6x4.rgb").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole frames"):
        read_raw(spark, str(tmp_path)).collect()
    for name in ("empty-6x4.rgb", "nosize.rgb"):
        (tmp_path / f"in-{name}").mkdir()
        (tmp_path / f"in-{name}" / name).write_bytes(b"")
        with pytest.raises(Exception, match="no frames in|no size in"):
            read_raw(spark, str(tmp_path / f"in-{name}")).collect()


def test_a_failed_stage_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from framegrid.operators.store import stored

    root = f"file://{tmp_path}/s"
    with pytest.raises(Exception, match="broken"):
        stored(spark, root, "k", lambda: spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")))
    assert not list((tmp_path / "s").glob("[!.]*"))
    assert stored(spark, root, "k", lambda: spark.range(9)).count() == 9 == stored(spark, root, "k", lambda: spark.range(5)).count()


def test_refusals(spark):
    boxes = spark.createDataFrame([(1, 0, None, None, None, None)], "clip_id int, frame_idx int, x0 double, y0 double, x1 double, y1 double")
    with pytest.raises(ValueError):
        B.resolved(boxes, "odd")
    assert B.smoothed(boxes).first().x0 is None and B.resolved(boxes, "clip_union").first().x0 is None
    with pytest.raises(Exception, match="clip of 1 frames, at most 0"):
        S.guarded(boxes, 0).collect()
    assert S.guarded(boxes, 1).count() == 1
