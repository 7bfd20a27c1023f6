"""Queries along motion, each beside its SQL: there the flow is an exhaustive search of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.functions import resample as R
from framegrid.operators import motion as X
from framegrid.plans import sql
from framegrid.plans.evaluation import SEARCH
from framegrid.plans.matte import _TOPO, levels, plain
from framegrid.plans.queries import _ROLL, _long, query

FLOW = sql.flow()


@query(sql.GRID + FLOW + "select clip_id, frame_idx, k, y, x, fy, fx from fw")
def pix_flow(spark, d):
    """Displacements of every pixel to the frame before and the one after."""

    def run(window: list) -> dict:
        own = X.W.grey(window[1]["rgb"])
        return {name: X.flow_between(own, X.W.grey(window[1 + k]["rgb"]), **SEARCH).ravel().astype(float).tolist() if window[1 + k] else None for k, name in ((-1, "back"), (1, "on"))}

    found = P.map_window(plain(spark, d), 1, 1, run, "back array<double>, on array<double>")
    out = None
    for k, name in ((-1, "back"), (1, "on")):
        cells = found.where(F.col(name).isNotNull()).select("clip_id", "frame_idx", F.lit(k).alias("k"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.struct(F.element_at(name, 2 * p + 1).alias("fy"), F.element_at(name, 2 * p + 2).alias("fx")))).alias("p", "f"))
        one = cells.select("clip_id", "frame_idx", "k", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("f.fy").cast("int").alias("fy"), F.col("f.fx").cast("int").alias("fx"))
        out = one if out is None else out.union(one)
    return out


@query(sql.GRID + FLOW + ", f as (select clip_id, frame_idx, count(*) filter ((px.a > 127) <> (other > 127)) as n from px join al using (clip_id, frame_idx, y, x) where k = 1 group by all)" + _ROLL)
def qc_chatter(spark, d):
    """Pixels whose mask differs from where they are in the next frame."""
    return X.chatter(plain(spark, d), **SEARCH)


@query(sql.GRID + FLOW + """select px.clip_id, px.frame_idx, px.y, px.x, case when u.other is null or v.other is null then px.a else greatest(least(u.other, px.a), least(greatest(u.other, px.a), v.other)) end as a
from px left join al u on u.clip_id = px.clip_id and u.frame_idx = px.frame_idx and u.y = px.y and u.x = px.x and u.k = -1 left join al v on v.clip_id = px.clip_id and v.frame_idx = px.frame_idx and v.y = px.y and v.x = px.x and v.k = 1""")
def matte_steadied(spark, d):
    """The middle of three frames' alpha along the flow, ends untouched."""
    return levels(X.steadied(plain(spark, d), 1, **SEARCH))


@query(_TOPO + FLOW + """select t.clip_id, t.frame_idx, t.y, t.x, case when other is null then case when hole then 255 else t.a end when hole and other > 127 then greatest(other, t.a) else t.a end as a
from tp t left join al on al.clip_id = t.clip_id and al.frame_idx = t.frame_idx and al.y = t.y and al.x = t.x and al.k = -1""")
def matte_topology_temporal(spark, d):
    """Holes filled only where the frame before, along the flow, was opaque."""
    return levels(X.topology_over_time(plain(spark, d), 0.05, **SEARCH))


@query(sql.GRID + FLOW + """, sd as materialized (select px.*, px.y * 8 + px.x as p, data[(px.y * 8 + px.x + 13) % 64 + 1] > 127 as s, abs(fy) + abs(fx) > 0 as mv
  from px join fr using (clip_id, frame_idx) left join fw on fw.clip_id = px.clip_id and fw.frame_idx = px.frame_idx and fw.y = px.y and fw.x = px.x and fw.k = -1),
fg as materialized (select * from sd where a > 127), n4 as materialized (select a.clip_id, a.frame_idx, a.p, b.p as q from fg a join fg b on a.clip_id = b.clip_id and a.frame_idx = b.frame_idx and abs(a.y - b.y) + abs(a.x - b.x) <= 1),
body(clip_id, frame_idx, p) as (select clip_id, frame_idx, p from fg where s union select b.clip_id, b.frame_idx, n4.q from body b join n4 on n4.clip_id = b.clip_id and n4.frame_idx = b.frame_idx and n4.p = b.p),
mo as (select p.clip_id, p.frame_idx, p.p, bool_or(q.mv) as moving from sd p join sd q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) + abs(p.x - q.x) <= 1 group by all)
select sd.clip_id, sd.frame_idx, y, x, case when s or (a > 127 and body.p is not null and coalesce(moving, false)) then a else 0 end as a from sd join mo using (clip_id, frame_idx, p) left join body using (clip_id, frame_idx, p)""")
def matte_limbs(spark, d):
    """Moving parts that hang on the kept body come back though the region left them out."""
    regions = P.map_packed(plain(spark, d), lambda rgb, a: {"region": np.roll(a.ravel(), -13)}, "region binary")
    return levels(X.limbs_restored(plain(spark, d).join(regions, ["clip_id", "frame_idx"]), 0.5, 1, **SEARCH))


# Motion maps and pixels that stand still

_SIGMA, _BELOW = 0.75, 152.137
_TAPS = np.exp(-0.5 * (np.arange(-3, 4) / _SIGMA) ** 2) / np.exp(-0.5 * (np.arange(-3, 4) / _SIGMA) ** 2).sum()
_GAUSS = ", ".join(f"({k}, {v!r}::double)" for k, v in zip(range(-3, 4), _TAPS.tolist()))
#: A place beyond the edge is the one mirrored about the outermost one.
_MIRROR = "case when {0} < 0 then -({0}) when {0} > 7 then 14 - ({0}) else {0} end"
_MOTION = sql.GRID + f""", ta(k, v) as (values {_GAUSS}),
st as materialized (select p.clip_id, p.frame_idx, p.y, p.x, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) as d from px p join px q on q.clip_id = p.clip_id and q.frame_idx = p.frame_idx - 1 and q.y = p.y and q.x = p.x),
vb as materialized (select o.clip_id, o.frame_idx, o.y, o.x, sum(v * n.d) as d from st o, ta, st n where n.clip_id = o.clip_id and n.frame_idx = o.frame_idx and n.x = o.x and n.y = {_MIRROR.format("o.y + k")} group by all),
hb as materialized (select o.clip_id, o.frame_idx, o.y, o.x, sum(v * n.d) as d from vb o, ta, vb n where n.clip_id = o.clip_id and n.frame_idx = o.frame_idx and n.y = o.y and n.x = {_MIRROR.format("o.x + k")} group by all),
mm as materialized (select clip_id, y, x, max(d) as d from hb group by all) """


@query(_MOTION + "select clip_id, y, x, round(d, 6) as motion from mm")
def pix_motion_map(spark, d):
    """The greatest blurred change of each pixel of a clip."""
    maps = X.motion_maps(plain(spark, d), _SIGMA).where("motion is not null")

    def run(batches):
        for b in batches:
            for clip, w, m in zip(*(b.column(c).to_pylist() for c in ("clip_id", "w", "motion"))):
                x = np.frombuffer(m, np.float64)
                p = np.arange(len(x), dtype=np.int32)
                yield P.pa.RecordBatch.from_arrays([P.pa.array([clip] * len(x), b.schema.field("clip_id").type), P.pa.array(p // w), P.pa.array(p % w), P.pa.array(x)], names=["clip_id", "y", "x", "motion"])

    clip = maps.schema["clip_id"].dataType.simpleString()
    return maps.mapInArrow(run, f"clip_id {clip}, y int, x int, motion double").withColumn("motion", F.round("motion", 6))


@query(_MOTION + f""", sp as (select clip_id, y, x from mm where d < {_BELOW}),
md as (select clip_id, y, x, floor(median(a))::int as a, floor(median(r))::int as r, floor(median(g))::int as g, floor(median(b))::int as b from px semi join sp using (clip_id, y, x) group by all)
select px.clip_id, px.frame_idx, px.y, px.x, coalesce(md.a, px.a) as a, coalesce(md.r, px.r) as r, coalesce(md.g, px.g) as g, coalesce(md.b, px.b) as b from px left join md using (clip_id, y, x)""")
def matte_still(spark, d):
    """Alpha and colours of pixels that never change much, held at their median over the clip."""
    frames = plain(spark, d)
    planes = X.still_planes(frames, X.motion_maps(frames, _SIGMA), _BELOW, colours=True)
    return P.unpack(X.frozen_still(frames, planes), {"a": 1, "rgb": 3})


@query(_MOTION + FLOW + f""", sp as (select clip_id, y, x from mm where d < {_BELOW}), md as (select clip_id, y, x, floor(median(a))::int as a from px semi join sp using (clip_id, y, x) group by all)
select px.clip_id, px.frame_idx, px.y, px.x, coalesce(md.a, case when u.other is null or v.other is null then px.a else greatest(least(u.other, px.a), least(greatest(u.other, px.a), v.other)) end) as a
from px left join md using (clip_id, y, x) left join al u on u.clip_id = px.clip_id and u.frame_idx = px.frame_idx and u.y = px.y and u.x = px.x and u.k = -1 left join al v on v.clip_id = px.clip_id and v.frame_idx = px.frame_idx and v.y = px.y and v.x = px.x and v.k = 1""")
def seq_smoothed_alpha(spark, d):
    """Alpha along the flow on moving pixels, held on those that stand still."""
    return levels(X.smoothed_over_time(plain(spark, d), 1, _BELOW, sigma=_SIGMA, **SEARCH))


# Resampling

_TO = (5, 3)


@query(sql.GRID + """, w as (select oy, ox, y, x, greatest(0, least((oy + 1) * 8, (y + 1) * 5) - greatest(oy * 8, y * 5)) * greatest(0, least((ox + 1) * 8, (x + 1) * 3) - greatest(ox * 8, x * 3)) as u from range(5) a(oy), range(3) b(ox), range(8) c(y), range(8) e(x))
select clip_id, frame_idx, oy::int as y, ox::int as x, round_even(sum(a * u) / 64e0, 0)::int as a from px join w using (y, x) where u > 0 group by all""")
def pix_area_resize(spark, d):
    """Frames at five by three pixels, each the mean of what it covers."""
    return levels(P.map_packed(plain(spark, d), lambda rgb, a: {"h": 5, "w": 3, "a": R.area(a, 5, 3)}, "h int, w int, a binary"))


@query(sql.GRID + """, ax as (select o, least(6, floor(greatest(0e0, least(7e0, (o + 0.5e0) * 8 / 11 - 0.5e0))))::int as i, greatest(0e0, least(7e0, (o + 0.5e0) * 8 / 11 - 0.5e0)) as pos from range(11) t(o)),
wt as (select o, i, 1 - (pos - i) as u from ax union all select o, i + 1, pos - i from ax)
select clip_id, frame_idx, v.o::int as y, h.o::int as x, round(sum(a * v.u * h.u), 6) as v from px join wt v on v.i = px.y join wt h on h.i = px.x group by all""")
def pix_bilinear_resize(spark, d):
    """Alpha at eleven by eleven pixels, interpolated between the centres of pixels."""
    out = P.map_packed(plain(spark, d), lambda rgb, a: {"data": R.bilinear(a, 11, 11).ravel().tolist()}, "data array<double>")
    cells = out.select("clip_id", "frame_idx", F.posexplode("data").alias("p", "v"))
    return cells.select("clip_id", "frame_idx", F.floor(F.col("p") / 11).cast("int").alias("y"), (F.col("p") % 11).cast("int").alias("x"), F.round("v", 6).alias("v"))
