"""Queries of matte operators over the packed frames, each beside its SQL."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import functions as F

from framegrid.functions import kernels as K
from framegrid.functions import packed as P
from framegrid.operators import keyer
from framegrid.operators import matte as M
from framegrid.operators.store import shared_folder, stored
from framegrid.operators.temporal import fill_gaps
from framegrid.plans import sql
from framegrid.plans.evaluation import SEARCH, near_backdrop
from framegrid.plans.keying import _KEY, models
from framegrid.plans.queries import _long, query
from framegrid.sources import proxies as V

#: Rules at the size of the frames.
CLEAR = M.CLEAR | {"sat": 230.0, "area_link": 6, "area": 10, "core": 1, "verdict": 0.5}
SUBJECT = M.SUBJECT | {"grow": 1, "overlap": 0.6, "rim": 1}

#: Colours of the plain frames: red is the level, green and blue are the pixels 21 and 42 places on.
_COMP = sql.LABELS
_OPAQUE = sql.GRID + ", fg as materialized (select clip_id, frame_idx, y, x, y * 8 + x as p from px where a > 127)" + _COMP + ", ca as materialized (select clip_id, frame_idx, label, count(*) as n from lab group by all) "


def plain(spark, d):
    """Packed frames of the levels, without a backdrop."""

    def paint(rgb, a, data):
        x = np.array(data, dtype=np.uint8)
        return {"h": V.SIDE, "w": V.SIDE, "rgb": np.stack((x, np.roll(x, -21), np.roll(x, -42)), axis=1), "a": x}

    f = V.frames(spark, d).withColumn("rgb", F.lit(b"\0" * (3 * V.SIDE**2))).withColumn("a", F.lit(b"\0" * V.SIDE**2))
    return P.map_packed(f, paint, M.FRAME, ("data",))


def plan_name(*parts) -> str:
    """A folder's name from all that a stage depends on."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:32]


def levels(frames):
    return P.unpack(frames.select("clip_id", "frame_idx", "h", "w", "a"), {"a": 1})


def reds(rgb: np.ndarray, m: np.ndarray) -> float:
    """A verdict that stands for the second look of a network: the last digit of the reds' sum."""
    return int(rgb[..., 0][m].astype(np.int64).sum() % 10) / 10


def candidates(spark, d):
    grey = F.array(F.lit(128.0), F.lit(128.0), F.lit(128.0))
    return M.islands(plain(spark, d).withColumn("bg", F.when(F.col("clip_id") % 4 > 0, grey)), reds, CLEAR)


_ISLANDS = sql.GRID + """, cs as (select *, y * 8 + x as p, case when greatest(r, g, b) = 0 then 0 else (greatest(r, g, b) - least(r, g, b)) * 255e0 / greatest(r, g, b) end as sat from px),
fg as materialized (select clip_id, frame_idx, y, x, p, r, g, b from cs where a > 127 and sat < 230)""" + _COMP + """,
co as (select l.clip_id, l.frame_idx, l.label, l.p from lab l where not exists (select 1 from px q where q.clip_id = l.clip_id and q.frame_idx = l.frame_idx and abs(q.y - l.y) <= 1 and abs(q.x - l.x) <= 1
  and not exists (select 1 from lab m where m.clip_id = q.clip_id and m.frame_idx = q.frame_idx and m.y = q.y and m.x = q.x and m.label = l.label))),
cm as (select clip_id, frame_idx, label, avg(r) as r, avg(g) as g, avg(b) as b from co join fg using (clip_id, frame_idx, p) group by all),
isl as materialized (select clip_id, frame_idx, label, count(*) as area, sum(fg.r) % 10 / 10e0 as verdict from lab join fg using (clip_id, frame_idx, p) join cm using (clip_id, frame_idx, label)
  where clip_id % 4 = 0 or sqrt(pow(cm.r - 128, 2) + pow(cm.g - 128, 2) + pow(cm.b - 128, 2)) <= 60 group by all having count(*) >= 6) """


@query(_ISLANDS + "select clip_id, frame_idx, label, area, verdict from isl")
def matte_islands(spark, d):
    """Grey, compact islands near the backdrop; every fourth clip has no backdrop's colour."""
    return candidates(spark, d).select("clip_id", "frame_idx", "label", "area", "verdict")


_TOPS = _ISLANDS + """, ip as materialized (select lab.*, area from lab join isl using (clip_id, frame_idx, label)),
lk as materialized (select a.clip_id, a.frame_idx * 64 + a.label as u, b.frame_idx * 64 + b.label as v from ip a join ip b on a.clip_id = b.clip_id and a.p = b.p and b.frame_idx - a.frame_idx between 1 and 3 group by all having count(*) >= 0.3e0 * least(any_value(a.area), any_value(b.area))),
sy as materialized (select clip_id, u, v from lk union select clip_id, v, u from lk), ra(clip_id, u, v) as (select clip_id, u, v from sy union select ra.clip_id, ra.u, sy.v from ra join sy on sy.clip_id = ra.clip_id and sy.u = ra.v),
mn as (select clip_id, u, min(v) as low from ra group by all),
tr as materialized (select isl.*, least(frame_idx * 64 + label, coalesce(low, frame_idx * 64 + label))::int as top from isl left join mn on mn.clip_id = isl.clip_id and mn.u = isl.frame_idx * 64 + isl.label) """


@query(_TOPS + "select clip_id, frame_idx, label, (top // 64)::int as track_frame, (top % 64)::int as track_label from tr")
def matte_tracks(spark, d):
    """Islands linked over up to three frames into tracks, named by their first island."""
    found = candidates(spark, d)
    return M.tracks(found, M.links(found, CLEAR))


_FIRED = _TOPS + """, ju as (select clip_id, top from tr group by all having count(*) filter (verdict >= 0.5e0) > 0 and count(*) filter (verdict >= 0.5e0) >= 0.3e0 * count(*) and max(area) filter (verdict >= 0.5e0) >= 10),
gone as materialized (select lab.clip_id, lab.frame_idx, lab.y, lab.x from lab join tr using (clip_id, frame_idx, label) join ju using (clip_id, top)) """


@query(_FIRED + "select px.clip_id, px.frame_idx, px.y, px.x, case when gone.y is null then a else 0 end as a from px left join gone using (clip_id, frame_idx, y, x)")
def matte_clears(spark, d):
    """Alpha with the islands of confirmed tracks transparent in every frame of the track."""
    found = candidates(spark, d)
    fired = M.cleared_islands(found, M.tracks(found, M.links(found, CLEAR)), CLEAR)
    return levels(M.cleared(plain(spark, d), fired))


@query(_OPAQUE + """, cm as (select clip_id, frame_idx, max(n) as m, count(*) as k from ca group by all),
pe as materialized (select clip_id, frame_idx, (p // 8)::int as y, (p % 8)::int as x from fr, range(64) t(p) where data[(p + 13) % 64 + 1] > 127 and frame_idx % 4 >= 2),
hp as (select distinct clip_id, frame_idx from pe),
cv as (select l.clip_id, l.frame_idx, l.label, count(*) filter (exists (select 1 from pe where pe.clip_id = l.clip_id and pe.frame_idx = l.frame_idx and abs(pe.y - l.y) + abs(pe.x - l.x) <= 1)) as n from lab l group by all),
tb as (select distinct clip_id, frame_idx, label from lab where y between 2 and 5 and x >= 1 + frame_idx % 3 and x < 4),
kp as materialized (select ca.*, ca.n >= 0.25e0 * m or (ca.frame_idx % 2 = 0 and case when hp.clip_id is not null then cv.n / ca.n::double >= 0.6e0 else tb.label is not null end) as keep, k from ca join cm using (clip_id, frame_idx) left join hp using (clip_id, frame_idx) left join cv using (clip_id, frame_idx, label) left join tb using (clip_id, frame_idx, label)),
st as materialized (select px.clip_id, px.frame_idx, px.y, px.x, px.a, coalesce(not keep, false) as dropped, coalesce(keep, false) as keep from px left join lab using (clip_id, frame_idx, y, x) left join kp using (clip_id, frame_idx, label))
select p.clip_id, p.frame_idx, p.y, p.x, case when p.dropped or (bool_or(q.dropped) and not bool_or(q.keep)) then 0 else p.a end as a
from st p join st q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) + abs(p.x - q.x) <= 1 group by p.clip_id, p.frame_idx, p.y, p.x, p.a, p.dropped""")
def matte_main_subject(spark, d):
    """The main subject by share, by a person's mask where there is one, else by the box; soft rims of what went go too."""
    i = F.col("frame_idx")
    box = F.when(i % 2 == 0, F.struct((1 + i % 3).cast("double").alias("x0"), F.lit(2.0).alias("y0"), F.lit(4.0).alias("x1"), F.lit(6.0).alias("y1")))
    masks = P.map_packed(plain(spark, d), lambda rgb, a: {"person": np.roll(a.ravel(), -13)}, "person binary").where("frame_idx % 4 >= 2")
    frames = plain(spark, d).join(masks, ["clip_id", "frame_idx"], "left").withColumn("box", box)
    return levels(M.keep_main_subject(frames, SUBJECT))


_TOPO = _OPAQUE + """, kp as materialized (select px.clip_id, px.frame_idx, px.y, px.x, px.y * 8 + px.x as p, case when a > 127 and coalesce(n, 0) < 0.05e0 * 64 or a <= 127 and false then 0 when a > 127 then a else 0 end as a from px left join lab using (clip_id, frame_idx, y, x) left join ca using (clip_id, frame_idx, label)),
bgr as materialized (select * from kp where a <= 127), bn as materialized (select a.clip_id, a.frame_idx, a.p, b.p as q from bgr a join bgr b on a.clip_id = b.clip_id and a.frame_idx = b.frame_idx and abs(a.y - b.y) + abs(a.x - b.x) = 1),
rc(clip_id, frame_idx, p) as (select clip_id, frame_idx, p from bgr where y in (0, 7) or x in (0, 7) union select r.clip_id, r.frame_idx, bn.q from rc r join bn on bn.clip_id = r.clip_id and bn.frame_idx = r.frame_idx and bn.p = r.p),
tp as materialized (select kp.*, a <= 127 and rc.p is null as hole from kp left join rc using (clip_id, frame_idx, p)) """


@query(_TOPO + "select clip_id, frame_idx, y, x, case when hole then 255 else a end as a from tp")
def matte_topology(spark, d):
    """Small components gone, holes filled."""
    return levels(M._alpha_only(plain(spark, d), lambda rgb, a: M.topology(a, 0.05)))


_TRI = sql.GRID + """, sd as materialized (select clip_id, frame_idx, y, x, a, data[(y * 8 + x + 13) % 64 + 1] > 127 as s from px join fr using (clip_id, frame_idx)),
n as materialized (select p.clip_id, p.frame_idx, p.y, p.x, p.a, bool_and(q.s) as s_in, bool_or(q.s) as s_out, bool_and(q.a / 255e0 > 0.9e0) as f_in, bool_or(q.a / 255e0 > 0.1e0) as f_out from sd p join sd q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) + abs(p.x - q.x) <= 1 group by p.clip_id, p.frame_idx, p.y, p.x, p.a) """


@query(_TRI + """select 'alpha' as form, clip_id, frame_idx, y, x, round(case when f_in then 1e0 when not f_out then 0e0 else a / 255e0 end, 6) as t from n
union all select 'additive', clip_id, frame_idx, y, x, round(case when s_in or a / 255e0 > 0.9e0 then 1e0 when not s_out and a / 255e0 < 0.1e0 then 0e0 else a / 255e0 end, 6) from n
union all select 'symmetric', clip_id, frame_idx, y, x, round(case when s_in then 1e0 when not s_out then 0e0 else a / 255e0 end, 6) from n""")
def matte_trimaps(spark, d):
    """Trimaps from alpha alone and, in both forms, by a seed mask."""
    seeds = P.map_packed(plain(spark, d), lambda rgb, a: {"seed": np.roll(a.ravel(), -13)}, "seed binary")
    frames = plain(spark, d).join(seeds, ["clip_id", "frame_idx"])
    out = None
    for form in (None, "additive", "symmetric"):
        t = M.trimaps(frames, 1, form).withColumnRenamed("t", "data")
        one = _long(t, "t").select(F.lit(form or "alpha").alias("form"), "clip_id", "frame_idx", "y", "x", F.round("t", 6).alias("t"))
        out = one if out is None else out.union(one)
    return out


@query(sql.GRID + """, ar as (select clip_id, frame_idx, count(*) filter (a > 127) as n from px group by all), l as (select *, coalesce(n < 0.95e0 * lag(n) over w and n < 0.95e0 * lead(n) over w, false) as fell from ar window w as (partition by clip_id order by frame_idx))
select l.clip_id, l.frame_idx, px.y, px.x, px.a from l join px on px.clip_id = l.clip_id and px.frame_idx = case when fell then l.frame_idx - 1 else l.frame_idx end""")
def matte_uncollapsed(spark, d):
    """Frames with less area than both neighbours take the content of the one before."""
    return levels(M.uncollapsed(plain(spark, d), 0.95))


@query(sql.GRID + """, pr as (select p.clip_id, p.frame_idx, p.y, p.x, q.r / 255e0 as i, q.a / 255e0 as v, p.r / 255e0 as own from (select clip_id, frame_idx, y, x, g as r, a from px) p join (select clip_id, frame_idx, y, x, g as r, a from px) q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 1),
m as materialized (select clip_id, frame_idx, y, x, any_value(own) as own, (avg(i * v) - avg(i) * avg(v)) / (avg(i * i) - avg(i) * avg(i) + 0.01e0) as k, avg(v) as mv, avg(i) as mi from pr group by all),
n as (select *, mv - k * mi as c from m) select p.clip_id, p.frame_idx, p.y, p.x, round(avg(q.k) * any_value(p.own) + avg(q.c), 6) as q from n p join n q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 1 group by p.clip_id, p.frame_idx, p.y, p.x""")
def matte_guided(spark, d):
    """Alpha filtered by the green channel as guide."""
    out = P.map_packed(plain(spark, d), lambda rgb, a: {"data": K.guided(rgb[..., 1] / 255.0, a / 255.0, 1, 0.01).ravel().tolist()}, "data array<double>")
    return _long(out, "q").withColumn("q", F.round("q", 6))


@query(sql.GRID + "select p.clip_id, p.frame_idx, p.y, p.x, round(min(sqrt(pow(p.y - q.y, 2) + pow(p.x - q.x, 2))) filter (q.a > 200), 6) as dist from px p join px q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx group by p.clip_id, p.frame_idx, p.y, p.x")
def matte_distance(spark, d):
    """Distance to the nearest strongly opaque pixel, null where a frame has none."""

    def run(rgb, a):
        x = K.distance(a > 200).ravel()
        return {"data": [None if np.isinf(v) else float(v) for v in x]}

    return _long(P.map_packed(plain(spark, d), run, "data array<double>"), "dist").withColumn("dist", F.round("dist", 6))


@query(None)
def matte_supersampled(spark, d):
    """One-bit alpha decided at four times the size."""
    return levels(M._alpha_only(plain(spark, d), lambda rgb, a: K.supersample_threshold(a)))


@query(sql.GRID + "select clip_id, frame_idx, y, x, round(case when a % 7 = 0 then 0 when a % 7 = 1 then 1 when a % 7 = 2 then 0 else greatest(0, least(1, a / 200e0 - 0.1e0)) end, 6) as alpha from px")
def pix_normal_alpha(spark, d):
    """Raw alphas with values that are no numbers and beyond the ends."""
    inf = float("inf")
    raw = F.transform("data", lambda v: F.when(v % 7 == 0, float("nan")).when(v % 7 == 1, inf).when(v % 7 == 2, -inf).otherwise(v / 200.0 - 0.1))
    f = V.frames(spark, d).withColumn("data", M.normal_alpha(raw))
    return _long(f, "alpha").withColumn("alpha", F.round("alpha", 6))


@query(sql.GRID + "select clip_id, frame_idx, y, x, floor(round(a / 255e0 * r + (1 - a / 255e0) * 255, 9))::int as r, floor(round(a / 255e0 * g, 9))::int as g, floor(round(a / 255e0 * b + (1 - a / 255e0) * 255, 9))::int as b from px")
def snk_composite(spark, d):
    """Frames over magenta, as on the sheet of the worst frames."""

    def run(rgb, a):
        share = a[..., None] / 255.0
        over = share * rgb + (1 - share) * np.array([255, 0, 255])
        return {"h": a.shape[0], "w": a.shape[1], "rgb": np.floor(np.round(over, 9)).astype(np.uint8)}

    return P.unpack(P.map_packed(plain(spark, d), run, "h int, w int, rgb binary"), {"rgb": 3})


@query(None)
def matte_despilled(spark, d):
    """Colours of mixed pixels by multi-level foreground estimation; a test holds it to colours that are known."""
    return P.unpack(M.despilled(V.scenes(spark, d)), {"rgb": 3})


@query(_KEY + "o as (select 1) select clip_id, frame_idx, y, x, case when safe then round_even(al * 255, 0)::int else r end as a from ka")
def seq_routes(spark, d):
    """Safe clips keyed by colour, the others matted by a model, for which the red channel stands."""
    scenes = V.scenes(spark, d)
    return levels(M.routed(scenes, models(spark, d), lambda: lambda rgb: rgb[..., 0]))


@query(sql.FILLED + "select clip_id, frame_idx, round(v, 6) as v from filled")
def seq_stage_store(spark, d):
    """A stage's rows made once, kept under its key, and read again instead of being made."""
    rows = V.track(spark, d).select("clip_id", "frame_idx", fill_gaps().alias("v")).select("clip_id", "frame_idx", F.round("v", 6).alias("v"))
    root, key = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}", plan_name("filled", 15)
    stored(spark, root, key, lambda: rows)

    def again():
        raise AssertionError("the stage is kept already")

    return stored(spark, root, key, again)


@query(None)
def matte_postprocess(spark, d):
    """All stages in their fixed order over the scenes; tests hold it against a plain version."""
    scenes = V.scenes(spark, d)
    out = M.postprocess(scenes, reds, near_backdrop, keyer.scaled(keyer.backdrop(scenes, 2)), CLEAR, SUBJECT, 0.2, **SEARCH)
    return levels(out)
