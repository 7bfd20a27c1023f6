"""Robust statistics of counted values."""

import numpy as np
from pyspark.sql import functions as F

from framegrid.operators import stats as ST


def test_sigma_clip_brings_together_counted_values_only(spark):
    own = spark.range(4000).select((F.col("id") % 2).cast("int").alias("clip_id"), (100 + F.col("id") % 7 + 90 * (F.col("id") % 97 == 3).cast("int")).cast("double").alias("cb"), F.when(F.col("id") % 1001 != 5, 90.0 + F.col("id") % 5).alias("cr"))
    got = ST.sigma_clip(own, "cb", "cr")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Scan parquet" in plan  # what follows the count doesn't read the rows again
    for r in got.collect():
        k = np.arange(r.clip_id, 4000, 2)
        u, v = 100.0 + k % 7 + 90 * (k % 97 == 3), np.where(k % 1001 != 5, 90.0 + k % 5, np.nan)
        keep = np.ones(len(k), bool)
        for _ in range(2):
            mu, mv = np.nanmedian(u[keep]), np.nanmedian(v[keep])
            su, sv = (max(1, 1.4826 * np.nanmedian(np.abs(x[keep] - m))) for x, m in ((u, mu), (v, mv)))
            d = np.hypot((u - mu) / su, (v - mv) / sv)
            keep = d < 5
        assert np.allclose((r.mu_u, r.mu_v, r.sd_u, r.sd_v, r.share), (mu, mv, su, sv, (d < 8)[~np.isnan(d)].mean())) and r.flat == (r.share > 0.98)


def test_percentiles_count_equal_values(spark):
    rows = spark.createDataFrame([(1, float(x), n) for x, n in ((0, 3), (5, 1), (9, 4))] + [(1, None, 7), (2, None, 1)], "clip_id int, x double, n int")
    got = ST.percentiles(rows, {"half": (F.col("x"), 0.5), "most": (F.col("x"), 0.9)}, F.col("n"))
    want = np.repeat([0.0, 5.0, 9.0], [3, 1, 4])
    assert {r.clip_id: (r.half, r.most) for r in got.collect()} == {1: (np.percentile(want, 50), np.percentile(want, 90)), 2: (None, None)}


def test_backdrop_of_many_colours_needs_no_python_task(spark):
    from framegrid.operators import keyer as K

    rng = np.random.default_rng(2)
    frames = [rng.integers(0, 256, (6, 6, 3)).astype(np.uint8) for _ in range(40)]
    df = spark.createDataFrame([(1, k, 6, 6, bytearray(f.tobytes()), None) for k, f in enumerate(frames)], "clip_id int, frame_idx int, h int, w int, rgb binary, a binary")
    got = K.backdrop(df, 1)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    edge = np.ones((6, 6), bool)
    edge[1:-1, 1:-1] = False
    rgb = np.concatenate([f[edge] for f in frames]).astype(float)
    strips = np.concatenate([x.reshape(-1, 3) for f in frames for x in (f[:1], f[-1:], f[:, :1], f[:, -1:])]).astype(float)
    luma = lambda x: x @ [0.299, 0.587, 0.114]
    chroma = lambda x: np.stack(((x[:, 2] - luma(x)) * 0.564 + 128, (x[:, 0] - luma(x)) * 0.713 + 128))
    uv, keep = chroma(rgb), np.ones(len(rgb), bool)
    for _ in range(2):
        mu = np.median(uv[:, keep], axis=1, keepdims=True)
        sd = np.maximum(1, 1.4826 * np.median(np.abs(uv[:, keep] - mu), axis=1, keepdims=True))
        keep = np.hypot(*((uv - mu) / sd)) < 5
    like = np.hypot(*((chroma(strips) - mu) / sd)) < 3
    r = got.first()
    assert np.allclose((r.mu_u, r.mu_v, r.sd_u, r.sd_v), (*mu.ravel(), *sd.ravel())) and np.allclose((r.bg_r, r.bg_g, r.bg_b), np.median(strips[like], axis=0))
