"""Crops, passes anew, closed-form refinement and sheets against drawn frames."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrid.functions import closedform as CF
from framegrid.operators import crops as C
from framegrid.operators import sheet
from framegrid.operators.store import written

from test_packed import packed


def test_laplacian_is_the_sum_over_windows():
    rng = np.random.default_rng(0)
    image, p = rng.random((6, 7, 3)), rng.random((6, 7))
    h, w = p.shape
    matrix = np.zeros((h * w, h * w))
    for y in range(h):
        for x in range(w):
            at = [(j, i) for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2))]
            c = np.array([image[q] for q in at])
            n, d = len(at), c - c.mean(axis=0)
            inverse = np.linalg.inv(d.T @ d / n + 1e-3 / n * np.eye(3))
            k = [j * w + i for j, i in at]
            matrix[np.ix_(k, k)] += np.eye(n) - (1 + d @ inverse @ d.T) / n
    assert np.allclose(CF.Laplacian(image, 1, 1e-3)(p), (matrix @ p.ravel()).reshape(h, w))


def mixture():
    yy, xx = np.mgrid[:90, :110]
    alpha = np.clip((26 - np.hypot(yy - 45, xx - 55) + 2 * np.sin(np.arctan2(yy - 45, xx - 55) * 9)) / 6 + 0.5, 0, 1)
    image = alpha[..., None] * np.array([0.8, 0.3, 0.2]) + (1 - alpha[..., None]) * np.stack((0.1 + xx / 500, 0.4 + yy / 400, 0.7 - xx / 600), axis=2)
    return np.rint(image * 255).astype(np.uint8), alpha


def test_a_known_mixture_is_recovered():
    rgb, alpha = mixture()
    rough = np.clip((alpha - 0.5) * 4 + 0.5, 0, 1)  # too hard
    out = CF.refined(rgb, rough)
    band = (alpha > 0.02) & (alpha < 0.98)
    assert np.abs(out - alpha)[band].mean() < 0.03 < np.abs(rough - alpha)[band].mean()
    assert np.abs(out - alpha)[~band].max() < 0.06


def test_refinement_keeps_what_it_cannot_mend(monkeypatch):
    rgb, alpha = mixture()
    assert CF.refined(rgb, np.zeros_like(alpha)).max() == 0  # hardly a subject
    monkeypatch.setattr(CF, "CAP", 40)
    shapes = []
    solve = CF.solve
    monkeypatch.setattr(CF, "solve", lambda image, *rest: (shapes.append(image.shape), solve(image, *rest))[1])
    assert np.abs(CF.refined(rgb, alpha) - alpha).mean() < 0.05 and max(shapes[0][:2]) <= 40

    def fails(*_):
        raise ArithmeticError("no")

    monkeypatch.setattr(CF, "solve", fails)
    assert CF.refined(rgb, alpha) is alpha


bright = lambda: lambda rgb: (rgb[..., 0] > 100).astype(float)  # noqa: E731  (sent to the workers as it is)


def subject(h, w, y0, y1, x0, x1):
    rgb = np.zeros((h, w, 3), np.uint8)
    rgb[y0:y1, x0:x1] = 200
    return rgb


def test_crop_edges():
    alpha = np.zeros((20, 30))
    alpha[5:9, 6:12] = 1
    assert C.cut_off(alpha, (5, 15, 2, 20)) and C.cut_off(alpha, (2, 9, 2, 20)) and C.cut_off(alpha, (2, 15, 6, 20)) and C.cut_off(alpha, (2, 15, 2, 12))
    assert not C.cut_off(alpha, (2, 15, 2, 20)) and not C.cut_off(np.ones((20, 30)), (0, 20, 0, 30)) and not C.cut_off(alpha, (4, 4, 0, 9))
    assert C.crop_of((10.9, 4.2, 20.7, 8.9), 20, 30, 0.12) == (4, 8, 9, 21) and C.crop_of(None, 20, 30) == (0, 20, 0, 30)
    assert C.probabilities(np.array([-2.0, 0.0, 3.0])).tolist() == pytest.approx([1 / (1 + np.e**2), 0.5, 1 / (1 + np.e**-3)]) and C.probabilities(np.array([0.2, np.nan])).tolist() == [0.2, 0]


def test_letterboxed_pass_pastes_back():
    rgb = subject(40, 60, 10, 30, 20, 40)
    alpha, crop = C.one_pass(rgb, (15.0, 5.0, 45.0, 35.0), bright(), 0.1, 64)
    assert crop == (2, 38, 12, 48) and alpha[20, 30] == 1 and alpha[:2].max() == 0 and alpha[:, :12].max() == 0
    assert np.abs(alpha - (rgb[..., 0] > 100)).mean() < 0.03


@pytest.mark.parametrize("side", [None, 32])
def test_truncated_frames_are_repaired(spark, side):
    """Frames 3 and 5 have boxes that cut the subject off; the box grown around the run's boxes holds it in 3 to 4, but not in 5."""
    boxes = [(4, 4, 20, 20)] * 8
    frames = [(subject(40, 40, 8, 16, 8, 16), np.zeros((40, 40), np.uint8)) for _ in range(8)]
    boxes[3] = (4, 4, 14, 20)
    frames[5] = (subject(40, 40, 8, 36, 8, 16), frames[5][1])
    boxes[7] = None
    side_table = spark.createDataFrame([(1, i, None if b is None else {"x0": float(b[0]), "y0": float(b[1]), "x1": float(b[2]), "y1": float(b[3])}) for i, b in enumerate(boxes)], "clip_id int, frame_idx int, box struct<x0:double,y0:double,x1:double,y1:double>")
    df = packed(spark, frames).join(side_table, ["clip_id", "frame_idx"])
    first = written(C.cropped(df, bright, 0.12, side, fallback=False))
    assert {r.frame_idx for r in first.where("truncated").collect()} == {3, 5}
    out = {r.frame_idx: r for r in C.repaired(df, first, bright, 0.12, side).collect()}
    assert {i: r.passes for i, r in out.items()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 1, 7: 1}
    for i, r in out.items():
        a = np.frombuffer(bytes(r.a), np.uint8).reshape(40, 40)
        assert ((a > 127) != (frames[i][0][..., 0] > 100)).mean() < (0.001 if side is None else 0.05), i
    alone = {r.frame_idx: (r.truncated, r.passes) for r in C.cropped(df, bright, 0.12, side).collect()}
    assert alone[3] == (True, 2) and alone[5] == (True, 2) and alone[0] == (False, 1)
    same = {r.frame_idx: r.passes for r in C.repaired(df.where("frame_idx in (0, 7)"), written(first.where("frame_idx in (0, 7)")), bright, 0.12, side).collect()}
    assert same == {0: 1, 7: 1}


def test_zoomed_verdicts_and_windows():
    mask = np.zeros((600, 900), bool)
    mask[590:600, 890:900] = True
    assert C.window_around(mask) == (88, 600, 388, 900)
    mask = np.zeros((30, 40), bool)
    mask[2:5, 1:4] = True
    assert C.window_around(mask, 8, 2) == (0, 7, 0, 6) or C.window_around(mask, 8, 2)[1] - C.window_around(mask, 8, 2)[0] == 8
    rgb = subject(30, 40, 2, 5, 1, 3)
    assert C.zoomed_verdict(bright, 8, 2, side=None)(rgb, mask) == pytest.approx(1 / 3) and C.zoomed_verdict(bright)(rgb, np.zeros_like(mask)) == 0


def test_sheets_are_images(spark):
    rng = np.random.default_rng(1)
    frames = [(rng.integers(0, 256, (4, 5, 3)).astype(np.uint8), rng.integers(0, 256, (4, 5)).astype(np.uint8)) for _ in range(3)]
    picks = spark.createDataFrame([(1, 2), (1, 0), (1, 2), (1, None), (2, 7)], "clip_id int, frame_idx int")
    (r,) = sheet.sheets(packed(spark, frames), picks).collect()
    assert r.frames == [0, 2] and (r.h, r.w) == (4, 10)
    want = np.concatenate([sheet.over(*frames[i]) for i in (0, 2)], axis=1)
    assert bytes(r.rgb) == want.tobytes()
    data = bytes(r.png)
    assert struct.unpack(">II", data[16:24]) == (10, 4)
    at = data.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]), np.uint8).reshape(4, 31)
    assert (rows[:, 0] == 0).all() and rows[:, 1:].tobytes() == want.tobytes()
    assert packed(spark, frames).select(F.count("*")).first()[0] == 3
