"""Queries of the quality bundle over the packed scenes, each beside its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.operators import evaluate as E
from framegrid.operators import keyer as K
from framegrid.plans import sql
from framegrid.plans.queries import query
from framegrid.sources import proxies as V

#: The scenes are small: interior is more than a pixel away, and quiet is a mean change below 12.
MARGIN, STILL, RING = 1, 12, 2
#: The flow of frames of eight pixels: whole displacements of up to a pixel, by windows of three.
SEARCH = {"levels": 1, "reach": 1, "radius": 1, "fine": False}

_ALL = sql.SCENE + sql.backdrop("su") + """,
dd as materialized (select su.*, flat, sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) as d from su join st using (clip_id)),
nb as materialized (select p.clip_id, p.frame_idx, p.y, p.x, any_value(p.a) as a, any_value(p.d) as d, any_value(p.flat) as flat, bool_or(q.d < 3 and (q.y - p.y) * (q.y - p.y) + (q.x - p.x) * (q.x - p.x) <= 1) as near, bool_and(q.a > 127) as every, bool_or(q.a > 127) as some_on
  from dd p join dd q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) <= 2 and abs(p.x - q.x) <= 2 group by p.clip_id, p.frame_idx, p.y, p.x),
bgr as materialized (select clip_id, frame_idx, y, x, y * 8 + x as p from sc where a <= 127),
bn as materialized (select a.clip_id, a.frame_idx, a.p, b.p as q from bgr a join bgr b on a.clip_id = b.clip_id and a.frame_idx = b.frame_idx and abs(a.y - b.y) + abs(a.x - b.x) = 1),
reached(clip_id, frame_idx, p) as (select clip_id, frame_idx, p from bgr where y in (0, 7) or x in (0, 7) union select r.clip_id, r.frame_idx, bn.q from reached r join bn on bn.clip_id = r.clip_id and bn.frame_idx = r.frame_idx and bn.p = r.p),
fg as materialized (select clip_id, frame_idx, y, x, y * 8 + x as p from sc where a > 127)""" + sql.LABELS + sql.CONTOURS + """,
ho as (select b.clip_id, b.frame_idx, count(*) filter (r.p is null) as f3 from bgr b left join reached r using (clip_id, frame_idx, p) group by all),
pf as materialized (select clip_id, frame_idx, any_value(flat) as flat, count(*) filter (d > 8 and a < 127) as f1, count(*) filter (d > 8 and a < 127 and not near) as f1i, count(*) filter (d < 3 and a >= 127) as f2, coalesce(any_value(f3), 0) as f3, count(*) filter (a > 127) as area,
  round(coalesce(any_value(len) / sqrt(nullif(count(*) filter (a > 127), 0)), 0), 9) as e1, avg(d) filter (a > 127 and not every) as e2, coalesce(avg((a > 0 and a < 255)::int) filter (some_on and not every), 0) as a2 from nb left join ho using (clip_id, frame_idx) left join cl using (clip_id, frame_idx) group by clip_id, frame_idx),
pj as (select *, round(abs(area - lag(area) over w) / greatest(lag(area) over w, 1)::double, 6) as jump from pf window w as (partition by clip_id order by frame_idx)),
st1 as materialized (select *, greatest(abs(lead(r) over w - r), abs(lead(g) over w - g), abs(lead(b) over w - b)) as mv, lead(a) over w as na from sc window w as (partition by clip_id, y, x order by frame_idx)),
st2 as (select *, avg(mv) over (partition by clip_id, y, x) < 12 as quiet from st1 where na is not null),
pe as materialized (select clip_id, frame_idx, count(*) filter (a > 127 and na > 127 and mv > 8 and quiet) as s2 from st2 group by all)""" + sql.flow("sc", "(1)") + """,
pc as (select clip_id, frame_idx, count(*) filter ((sc.a > 127) <> (al.other > 127)) as s1 from sc join al using (clip_id, frame_idx, y, x) group by all),
ps as (select * from pe join pc using (clip_id, frame_idx)),
fz as (select clip_id, count(*) filter (s) as s3 from (select clip_id, min(r) = max(r) and min(g) = max(g) and min(b) = max(b) and bool_and(a > 127) as s from sc group by clip_id, y, x) group by 1),
s4 as (select clip_id, arg_max(frame_idx, (jump, -frame_idx)) as s4_worst_frame, max(jump) as s4_worst, round(avg(jump), 6) as s4_mean from pj where jump is not null group by 1),
s12 as (select clip_id, sum(s1)::bigint as s1_total, sum(s2)::bigint as s2_total, arg_max(frame_idx, (s1, -frame_idx)) as s1_worst_frame, arg_max(frame_idx, (s2, -frame_idx)) as s2_worst_frame, max(s1) as s1_worst, max(s2) as s2_worst,
  round(avg(s1), 6) as s1_mean, round(avg(s2), 6) as s2_mean from ps group by 1),
a1 as (select clip_id, round(avg(sad), 6) as a1_mean, arg_max(frame_idx, (sad, -frame_idx)) as a1_worst_frame, round(max(sad), 6) as a1_worst
  from (select clip_id, frame_idx, round(avg(abs(a - (case when clip_id % 2 = 0 then (a * 7 % 256) / 255e0 * 255 else a * 7 % 256 end))), 9) as sad from sc group by all) group by 1) """


def raw_alphas(spark, d):
    """Alpha before it was stored, of 0..1 in every other clip and of 0..255 in the rest."""
    return V.frames(spark, d).select("clip_id", "frame_idx", F.transform("data", lambda v: (v * 7 % 256).cast("double") / F.when(F.col("clip_id") % 2 == 0, 255.0).otherwise(1.0)).alias("raw"))


@query(_ALL + """select clip_id, flat, case when flat then sum(f1)::bigint end as f1_total, case when flat then sum(f1i)::bigint end as f1i_total, case when flat then sum(f2)::bigint end as f2_total, sum(f3)::bigint as f3_total,
case when flat then arg_max(frame_idx, (f1, -frame_idx)) end as f1_worst_frame, case when flat then arg_max(frame_idx, (f1i, -frame_idx)) end as f1i_worst_frame, case when flat then arg_max(frame_idx, (f2, -frame_idx)) end as f2_worst_frame, arg_max(frame_idx, (f3, -frame_idx)) as f3_worst_frame,
case when flat then max(f1) end as f1_worst, case when flat then max(f1i) end as f1i_worst, case when flat then max(f2) end as f2_worst, max(f3) as f3_worst,
round(coalesce(median(e1) filter (e1 > 0), 0), 6) as e1_median, arg_max(frame_idx, (e1, -frame_idx)) as e1_worst_frame, round(max(e1), 6) as e1_worst, case when flat then round(coalesce(avg(e2), 0), 6) end as e2_mean, case when flat then round(coalesce(min(e2), 0), 6) end as e2_worst, case when flat then coalesce(arg_min(frame_idx, (round(e2, 9), frame_idx)) filter (e2 is not null), 0) end as e2_worst_frame,
round(avg(a2), 6) as a2_mean, round(max(a2), 6) as a2_worst, arg_max(frame_idx, (a2, -frame_idx)) as a2_worst_frame, any_value(a1_mean) as a1_mean, any_value(a1_worst_frame) as a1_worst_frame, any_value(a1_worst) as a1_worst,
any_value(s1_worst) as s1_worst, any_value(s2_worst) as s2_worst, any_value(s1_mean) as s1_mean, any_value(s2_mean) as s2_mean, any_value(s1_total) as s1_total, any_value(s2_total) as s2_total, any_value(s1_worst_frame) as s1_worst_frame, any_value(s2_worst_frame) as s2_worst_frame, any_value(s3) as s3, any_value(s4_worst_frame) as s4_worst_frame, any_value(s4_worst) as s4_worst, any_value(s4_mean) as s4_mean
from pf left join s12 using (clip_id) left join fz using (clip_id) left join s4 using (clip_id) left join a1 using (clip_id) group by clip_id, flat""")
def qc_bundle(spark, d):
    """All metrics of every clip in one row; null where the backdrop isn't flat."""
    scenes = V.scenes(spark, d)
    out = E.evaluate(scenes, scenes, K.scaled(K.backdrop(scenes, RING)), MARGIN, STILL, raw_alphas(spark, d), **SEARCH)
    rounded = [c for c, kind in out.dtypes if kind == "double" and not c.startswith("s4")]
    return out.select(*(F.round(c, 6).alias(c) if c in rounded else c for c in out.columns))


@query(_ALL + "select clip_id, sum(f1i)::bigint as total, arg_max(frame_idx, (f1i, -frame_idx)) as worst_frame, max(f1i)::bigint as worst_value from pf where flat group by 1")
def qc_false_erase_interior(spark, d):
    """Subject erased further than the margin from any backdrop pixel."""
    scenes = V.scenes(spark, d)
    stats = K.scaled(K.backdrop(scenes, RING)).where("flat")
    f = E.frame_metrics(K._with_model(E.fitted(scenes, scenes), stats), MARGIN)
    return f.groupBy("clip_id").agg(F.sum("f1i").alias("total"), E.worst("f1i").alias("worst_frame"), F.max("f1i").alias("worst_value"))


@query(_ALL + "select clip_id, frame_idx, round(e1, 6) as ratio, round(e2, 6) as fringe from pf")
def qc_edges(spark, d):
    """Length of the outer contours over the root of the area, and mean distance from the backdrop in the two-pixel edge, by frame."""
    scenes = V.scenes(spark, d)
    f = E.frame_metrics(K._with_model(E.fitted(scenes, scenes), K.scaled(K.backdrop(scenes, RING))), MARGIN)
    return f.select("clip_id", "frame_idx", F.round("e1", 6).alias("ratio"), F.round("e2", 6).alias("fringe"))


@query(sql.SCENE + "select clip_id, frame_idx, round(avg(abs(a - (case when clip_id % 2 = 0 then (a * 7 % 256) / 255e0 * 255 else a * 7 % 256 end))), 6) as sad from sc group by all")
def qc_raw_sad(spark, d):
    """Difference from the raw alpha."""
    scenes = V.scenes(spark, d)
    return E.raw_alpha_sad(scenes, raw_alphas(spark, d)).withColumn("sad", F.round("sad", 6))


def near_backdrop(rgb: np.ndarray, a: np.ndarray, m: dict) -> np.ndarray:
    """Opaque pixels whose colour is near the backdrop's."""
    return (a > 127) & (P.distance_from(rgb.astype(np.float64), m) < 20)


@query(_ALL + """, i as (select p.clip_id, p.frame_idx, p.y, p.x, bool_and(q.a > 127) as deep from dd p join dd q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) + abs(p.x - q.x) <= 1 group by all)
select clip_id, round(count(*) filter (a > 127 and d < 20 and deep) / greatest(count(*) filter (a > 127), 1)::double, 6) as fraction, count(*) filter (a > 127 and d < 20 and deep) / greatest(count(*) filter (a > 127), 1)::double <= 0.05e0 as safe from dd join i using (clip_id, frame_idx, y, x) group by 1""")
def qc_fringe_safety(spark, d):
    """Whether fringe candidates stay out of the subject's inside."""
    scenes = V.scenes(spark, d)
    out = E.fringe_safety(scenes, near_backdrop, K.scaled(K.backdrop(scenes, RING)), most=0.05)
    return out.withColumn("fraction", F.round("fraction", 6))
