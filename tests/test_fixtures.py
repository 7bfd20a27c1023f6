"""Operators on small cases worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from framegrid.functions import kernels as K
from framegrid.operators import detection as D
from framegrid.operators import service as S
from framegrid.operators import temporal as T


def track(spark, values, name="v"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"clip_id int, frame_idx int, {name} double")


def test_fill(spark):
    df = track(spark, [None, None, 3.0, None, 5.0, None]).select("frame_idx", T.fill_gaps("v").alias("f")).orderBy("frame_idx")
    assert [r.f for r in df.collect()] == [3, 3, 3, 3, 5, 5]
    assert all(r.f is None for r in track(spark, [None, None]).select(T.fill_gaps("v").alias("f")).collect())


def test_regions(spark):
    df = spark.createDataFrame([(1, i) for i in (2, 3, 7, 12)], "clip_id int, frame_idx int")
    assert sorted(map(tuple, T.regions(df, F.lit(True)).select("first", "last").collect())) == [(2, 7), (12, 12)]


def test_hysteresis(spark):
    got = T.hysteresis(track(spark, [10.0, 12.0, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0]), "v").orderBy("frame_idx").collect()
    assert [r.applied for r in got] == [10, 12, 12, 12, 12, 12, 8, 8]


def test_collapse(spark):
    df = track(spark, [100.0, 50.0, 100.0, 100.0]).select("frame_idx", T.collapsed("v").alias("c")).orderBy("frame_idx")
    assert [r.c for r in df.collect()] == [False, True, False, False]


def test_kernels():
    rng = np.random.default_rng(0)
    m = rng.random((9, 11)) > 0.6
    label = K.components(m)
    for y, x in zip(*np.nonzero(m)):
        for dy, dx in K.EIGHT:
            if 0 <= y + dy < 9 and 0 <= x + dx < 11 and m[y + dy, x + dx]:
                assert label[y, x] == label[y + dy, x + dx]
    d = K.distance(m)
    ys, xs = np.nonzero(m)
    assert np.isclose(d[0, 0], np.sqrt((ys**2 + xs**2).min()))
    ring = np.zeros((5, 5), bool)
    ring[1:4, 1:4] = True
    ring[2, 2] = False
    assert K.holes(ring).sum() == 1 and K.holes(ring)[2, 2]
    assert K.erode(ring | True).all() and K.dilate(ring)[0].all()
    assert K.keep_boxes(np.array([[0, 0, 2, 2], [0, 0, 2, 2], [5, 5, 6, 6]]), np.array([0.5, 0.9, 0.1])) == [1, 2]
    assert (K.supersample_threshold(np.full((4, 4), 255)) == 255).all()


def test_service(spark):
    rows = spark.createDataFrame([("a.mp4", "x" * 600), ("b", "at /srv/data/in/clip.mp4: bad")], "n string, m string")
    got = rows.select(S.sanitize(F.col("m")).alias("s")).collect()
    assert len(got[0].s) == 501 and got[1].s == "at clip.mp4: bad"
    assert abs(sum(w for _, _, w in S.stage_bases(qc=False)) - 1) < 1e-9


def test_non_maximum(spark):
    rows = [(1, 0, 0, 0, 10, 10, 0, 0.5), (1, 1, 0, 0, 10, 11, 0, 0.9), (1, 2, 20, 20, 30, 30, 1, 0.3), (1, 3, 50, 50, 60, 60, 0, 0.1), (2, 0, 0, 0, 10, 10, 0, 0.5)]
    boxes = spark.createDataFrame(rows, "frame long, det int, x0 int, y0 int, x1 int, y1 int, cls int, conf double")
    assert sorted(map(tuple, D.non_maximum(boxes, ["frame"]).collect())) == [(1, 1), (1, 2), (2, 0)]
    assert {r.frame: r.det for r in D.subject_box(boxes, ["frame"], 10_000).collect()} == {1: 1, 2: None}
    assert D.non_maximum(boxes.limit(0), ["frame"]).count() == 0
