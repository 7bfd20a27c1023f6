"""Flow, resampling, contours and windows of frames against plain versions."""

import numpy as np
import pytest

from framegrid.functions import flow as W
from framegrid.functions import kernels as K
from framegrid.functions import packed as P
from framegrid.functions import resample as R
from framegrid.operators import evaluate as E
from framegrid.operators import motion as X

from test_packed import packed


@pytest.mark.parametrize("dy, dx", [(0, 0), (3, -5), (0, 7), (-6, 2)])
def test_flow_finds_drawn_translations(dy, dx):
    big = R.gaussian(np.random.default_rng(0).random((140, 160)), 1.0)
    big = np.rint((big - big.min()) / (big.max() - big.min()) * 255)
    a, b = big[20:120, 20:140], big[20 - dy : 120 - dy, 20 - dx : 140 - dx]
    apart = np.hypot(*np.moveaxis(W.flow(a, b) - (dy, dx), 2, 0))[16:-16, 16:-16]
    assert np.median(apart) < 0.2 and (apart < 0.5).mean() > 0.95
    inner = (slice(20, -20), slice(20, -20))
    assert np.abs(W.warp(b, W.flow(a, b)) - a)[inner].mean() < 0.25 * max(1, np.abs(b - a)[inner].mean())
    half = W.flow_between(a.astype(int), b.astype(int), scale=0.5)[inner]
    assert np.median(np.hypot(*np.moveaxis(half - (dy, dx), 2, 0))) < 1


def test_search_is_exhaustive():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (7, 9)), rng.integers(0, 9, (7, 9))
    got = W.flow(a, b, levels=1, reach=2, radius=1, fine=False)
    at = lambda y, x: (min(max(y, 0), 6), min(max(x, 0), 8))
    for y in range(7):
        for x in range(9):
            costs = {}
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    around = [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= y + i < 7 and 0 <= x + j < 9]
                    costs[dy, dx] = (sum((int(a[p]) - int(b[at(p[0] + dy, p[1] + dx)])) ** 2 for p in around), dy * dy + dx * dx, dy, dx)
            assert tuple(got[y, x]) == min(costs, key=costs.get)


def test_warp_between_pixels():
    x = np.arange(12.0).reshape(3, 4)
    along = np.zeros((3, 4, 2)) + (0.5, 0.25)
    assert W.warp(x, along)[0, 0] == pytest.approx(0.5 * 4 + 0.25) and W.warp(x, along)[2, 3] == 11
    assert W.warp(x, along + (0.1, 0.4), nearest=True)[0, 0] == 5


@pytest.mark.parametrize("shape", [(8, 8), (5, 11), (1, 4), (7, 1)])
def test_area_resampling_by_overlaps(shape):
    x = np.random.default_rng(2).integers(0, 256, (*shape, 3)).astype(np.uint8)
    for h, w in ((3, 2), (1, 1), (5, 3), shape, (9, 13)):
        overlap = lambda o, n, i, m: max(0, min((o + 1) * m, (i + 1) * n) - max(o * m, i * n))
        v = np.array([[overlap(o, h, i, shape[0]) for i in range(shape[0])] for o in range(h)])
        u = np.array([[overlap(o, w, i, shape[1]) for i in range(shape[1])] for o in range(w)])
        want = np.einsum("oi,pj,ijc->opc", v, u, x.astype(int)) / (shape[0] * shape[1])
        assert np.allclose(R.area(x.astype(float), h, w), want) and (R.area(x, h, w) == np.rint(want)).all()
    assert R.resized(x, *shape) is x and R.resized(x, 20, 30).shape == (20, 30, 3) and R.resized(x, 20, 30).dtype == np.uint8


def test_gaussian_and_linear():
    one = np.zeros((31, 31))
    one[15, 15] = 1
    out = R.gaussian(one, 2.0)
    assert out.sum() == pytest.approx(1) and out[15, 15] == out.max() and out[15, 17] / out[15, 15] == pytest.approx(np.exp(-0.5))
    assert np.allclose(R.gaussian(np.full((3, 4), 7.0), 3.0), 7) and np.allclose(R.gaussian(np.full((1, 1), 7.0), 3.0), 7)
    assert R.bilinear(np.array([[0.0, 8.0]]), 1, 4).tolist() == [[0, 2, 6, 8]]


def test_distance_and_box_sums():
    rng = np.random.default_rng(4)
    for shape in ((9, 13), (1, 6), (6, 1)):
        m = rng.random(shape) < 0.15
        ys, xs = np.nonzero(m)
        yy, xx = np.indices(shape)
        want = np.sqrt(((yy[..., None] - ys) ** 2 + (xx[..., None] - xs) ** 2).min(axis=-1)) if len(ys) else np.full(shape, np.inf)
        assert np.array_equal(K.distance(m), want)
        a = rng.random(shape)
        for r in (0, 1, 4):
            want = np.array([[a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].sum() for x in range(shape[1])] for y in range(shape[0])])
            assert np.allclose(K.box_sum(a, r), want)


def test_outer_contours():
    m = np.zeros((9, 12), bool)
    m[1:8, 1:8] = True
    assert E.contour_length(m) == 24
    m[3:6, 3:6] = False
    assert E.contour_length(m) == 24  # a hole has no outer contour
    m[4, 4] = True
    assert E.contour_length(m) == 24  # nor has what lies in it
    m[4, 10] = True
    assert E.contour_length(m) == 24  # a pixel alone has length 0
    m[5, 11] = True
    assert E.contour_length(m) == pytest.approx(24 + 2 * 2**0.5)  # there and back
    assert E.contour_length(np.zeros((3, 3), bool)) == 0 and E.contour_length(np.ones((3, 4), bool)) == 10
    diamond = np.abs(np.indices((5, 5)) - 2).sum(axis=0) <= 2
    assert E.contour_length(diamond) == pytest.approx(8 * 2**0.5)


def test_windows_over_stretches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frames = [(rng.integers(0, 256, (3, 4, 3)).astype(np.uint8), np.full((3, 4), i, np.uint8)) for i in range(150)]
    df = packed(spark, frames).where("frame_idx not in (64, 70, 71)").unionByName(packed(spark, frames[:2], clip=2))
    look = lambda window: {"v": [float(f["a"][0, 0]) if f else -1.0 for f in window]}
    got = {(r.clip_id, r.frame_idx): r.v for r in P.map_window(df.repartition(7), 2, 1, look, "v array<double>").collect()}
    there = {(1, i) for i in range(150) if i not in (64, 70, 71)} | {(2, 0), (2, 1)}
    assert set(got) == there
    for c, i in there:
        assert got[c, i] == [float(i + k) if (c, i + k) in there else -1.0 for k in (-2, -1, 0, 1)]
    side = spark.createDataFrame([(1, "x"), (2, "y")], "clip_id int, tag string")
    assert sorted((r.clip_id, r.frame_idx, r.tag) for r in P.with_clip(df, side).select("clip_id", "frame_idx", "tag").collect()) == sorted((c, i, "x" if c == 1 else "y") for c, i in there)


def test_still_pixels_are_held_at_their_median(spark):
    rng = np.random.default_rng(6)
    frames = []
    for i in range(6):
        rgb = np.full((6, 8, 3), 90, np.uint8) + rng.integers(0, 3, (6, 8, 3)).astype(np.uint8)
        rgb[2:4, 5:7] = 20 * i  # moves
        frames.append((rgb, rng.integers(0, 256, (6, 8)).astype(np.uint8)))
    df = packed(spark, frames).unionByName(packed(spark, frames[:1], clip=2))
    motion = X.motion_maps(df, 0.5)
    planes = X.still_planes(df, motion, 10.0, colours=True)
    out = {(r.clip_id, r.frame_idx): r for r in X.frozen_still(df, planes).collect()}
    most = np.max([R.gaussian(np.abs(frames[i][0].astype(int) - frames[i - 1][0]).max(axis=2), 0.5) for i in range(1, 6)], axis=0)
    still = most < 10
    assert still.any() and not still.all()
    alphas, colours = np.stack([a for _, a in frames]), np.stack([rgb for rgb, _ in frames])
    for i in range(6):
        a, rgb = np.frombuffer(bytes(out[1, i].a), np.uint8).reshape(6, 8), np.frombuffer(bytes(out[1, i].rgb), np.uint8).reshape(6, 8, 3)
        assert (a == np.where(still, np.median(alphas, axis=0).astype(np.uint8), alphas[i])).all()
        assert (rgb == np.where(still[..., None], np.median(colours, axis=0).astype(np.uint8), colours[i])).all()
    assert bytes(out[2, 0].a) == frames[0][1].tobytes()  # one frame has no motion
    same = X.smoothed_over_time(df, half=0).collect()
    assert sorted((r.clip_id, r.frame_idx, bytes(r.a)) for r in same) == sorted((r.clip_id, r.frame_idx, bytes(r.a)) for r in df.collect())
    with pytest.raises(ValueError):
        X.steadied(df, -1)


def test_median_of_five_frames_along_the_flow(spark):
    rng = np.random.default_rng(7)
    frames = [(rng.integers(0, 256, (10, 9, 3)).astype(np.uint8), rng.integers(0, 256, (10, 9)).astype(np.uint8)) for _ in range(6)]
    search = {"levels": 1, "reach": 1, "radius": 1, "fine": True}
    out = {r.frame_idx: np.frombuffer(bytes(r.a), np.uint8).reshape(10, 9) for r in X.steadied(packed(spark, frames), 2, **search).collect()}
    for i, (rgb, a) in enumerate(frames):
        want = a
        if 2 <= i < 4:
            layers = [a] + [np.rint(W.warp(frames[j][1], W.flow(W.grey(rgb), W.grey(frames[j][0]), **search))) for j in range(i - 2, i + 3) if j != i]
            want = np.median(np.stack(layers), axis=0).astype(np.uint8)
        assert (out[i] == want).all()
