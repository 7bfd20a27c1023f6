"""Queries of boxes by frame, each beside its SQL; a user's events are a clip, their values give the boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegrid.operators import boxes as B
from framegrid.operators import temporal as T
from framegrid.plans import sql
from framegrid.plans.queries import query
from framegrid.sources import proxies as V

_BOXES = sql.TRACK + """, bx as materialized (select clip_id, frame_idx, 20 + frame_idx % 30 + value / 20.3e0 as x0, 30 + value / 30.7e0 as y0, 60 + frame_idx % 30 + value / 8.1e0 as x1, 90 + value / 12.7e0 as y1, frame_idx % 11 < 3 and coalesce(value, 50) > 20 as truncated from track) """


def found(spark, d):
    v, i = F.col("value"), F.col("frame_idx") % 30
    box = ((20 + i + v / 20.3).alias("x0"), (30 + v / 30.7).alias("y0"), (60 + i + v / 8.1).alias("x1"), (90 + v / 12.7).alias("y1"))
    return V.track(spark, d).select("clip_id", "frame_idx", *box, ((F.col("frame_idx") % 11 < 3) & (F.coalesce(v, F.lit(50.0)) > 20)).alias("truncated"))


def _rounded(df, *others):
    return df.select("clip_id", "frame_idx", *others, *(F.round(c, 5).alias(c) for c in B.BOX))


_FILL = ", ".join(f"coalesce(last_value({c} ignore nulls) over (w rows between unbounded preceding and current row), first_value({c} ignore nulls) over (w rows between current row and unbounded following)) as {c}" for c in B.BOX)
_MED = ", ".join(f"median({e}) over (partition by clip_id order by frame_idx rows between 7 preceding and 7 following) as {n}" for n, e in (("cx", "(x0 + x1) / 2"), ("cy", "(y0 + y1) / 2"), ("bw", "x1 - x0"), ("bh", "y1 - y0")))
_SMOOTH = _BOXES + f""", fl as (select clip_id, frame_idx, {_FILL} from bx window w as (partition by clip_id order by frame_idx)), md as materialized (select clip_id, frame_idx, {_MED} from fl),
hy as (select clip_id, frame_idx, cx, cy, bw as aw, bh as ah, 0 as n from md where frame_idx = 0 union all
  select m.clip_id, m.frame_idx, m.cx, m.cy, case when t then m.bw else h.aw end, case when t then m.bh else h.ah end, case when t then 0 else h.n + 1 end
  from hy h join md m on m.clip_id = h.clip_id and m.frame_idx = h.frame_idx + 1, lateral (select m.bw * m.bh >= h.aw * h.ah or h.n + 1 >= 5 as t)) """


@query(_SMOOTH + """, un as (select clip_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from bx group by 1),
m as (select 'per_frame' as mode, clip_id, frame_idx, x0, y0, x1, y1 from bx union all select 'clip_union', clip_id, frame_idx, un.x0, un.y0, un.x1, un.y1 from bx join un using (clip_id) union all select 'smoothed', clip_id, frame_idx, cx - aw / 2, cy - ah / 2, cx + aw / 2, cy + ah / 2 from hy)
select mode, clip_id, frame_idx, round(x0, 5) as x0, round(y0, 5) as y0, round(x1, 5) as x1, round(y1, 5) as y1 from m""")
def seq_boxes(spark, d):
    """Every frame's box in each of the three modes."""
    boxes = found(spark, d)
    parts = [_rounded(B.resolved(boxes, m), F.lit(m).alias("mode")) for m in B.MODES]
    return parts[0].union(parts[1]).union(parts[2])


@query(_SMOOTH + """, un as (select clip_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from bx group by 1),
m as (select 'per_frame' as mode, clip_id, x0, y0, x1, y1 from bx union all select 'clip_union', clip_id, un.x0, un.y0, un.x1, un.y1 from bx join un using (clip_id)
  union all select 'smoothed', clip_id, cx - aw / 2, cy - ah / 2, cx + aw / 2, cy + ah / 2 from hy)
select clip_id, mode, count(*) as n, count(x0) as boxed, round(max((x1 - x0) * (y1 - y0)), 4) as largest from m group by all""")
def seq_modes(spark, d):
    """What each mode makes of a clip: frames, frames with a box, and the largest box."""
    boxes, area = found(spark, d), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    out = None
    for m in B.MODES:
        one = B.resolved(boxes, m).groupBy("clip_id").agg(F.count("*").alias("n"), F.count("x0").alias("boxed"), F.round(F.max(area), 4).alias("largest"))
        one = one.select("clip_id", F.lit(m).alias("mode"), "n", "boxed", "largest")
        out = one if out is None else out.union(one)
    return out


_RUNS = """, h as (select clip_id, frame_idx, coalesce((frame_idx - lag(frame_idx) over (partition by clip_id order by frame_idx) > 4)::int, 0) as new from bx where truncated),
r as (select clip_id, min(frame_idx)::int as lo, max(frame_idx)::int as hi from (select clip_id, frame_idx, sum(new) over (partition by clip_id order by frame_idx) as run from h) group by clip_id, run),
u as (select r.clip_id, lo, hi, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from r join bx on bx.clip_id = r.clip_id and frame_idx between lo and hi group by all),
g as (select clip_id, lo, hi, greatest(0, (x0 + x1) / 2 - (x1 - x0) * 0.75e0) as x0, greatest(0, (y0 + y1) / 2 - (y1 - y0) * 0.75e0) as y0, least(120e0, (x0 + x1) / 2 + (x1 - x0) * 0.75e0) as x1, least(110e0, (y0 + y1) / 2 + (y1 - y0) * 0.75e0) as y1 from u) """


@query(_BOXES + _RUNS + """select bx.clip_id, frame_idx, g.lo as "first", g.hi as "last", case when frame_idx % 5 > 0 and u.x0 is not null then round(g.x0, 5) end as x0, case when frame_idx % 5 > 0 and u.x0 is not null then round(g.y0, 5) end as y0, case when frame_idx % 5 > 0 and u.x0 is not null then round(g.x1, 5) end as x1, case when frame_idx % 5 > 0 and u.x0 is not null then round(g.y1, 5) end as y1 from bx join g on g.clip_id = bx.clip_id and frame_idx between g.lo and g.hi join u on u.clip_id = g.clip_id and u.lo = g.lo""")
def seq_repair(spark, d):
    """Frames to matte again with their grown boxes; every fifth touches its edge again and gets the full frame."""
    again = B.repairs(found(spark, d), F.lit(120), F.lit(110))
    return _rounded(B.full_frame_where(again, F.col("frame_idx") % 5 == 0), "first", "last")


@query(sql.TRACK + """, f as (select clip_id, frame_idx, event_type, coalesce(value, 0) as area from track), n as (select *, lag(area) over w as p, lead(area) over w as q, lag(event_type) over w as pe from f window w as (partition by clip_id order by frame_idx))
select clip_id, frame_idx, coalesce(area < 0.6e0 * p and area < 0.6e0 * q, false) as collapsed, case when coalesce(area < 0.6e0 * p and area < 0.6e0 * q, false) then pe else event_type end as payload from n""")
def seq_collapse_payload(spark, d):
    """A collapsed frame takes the content of the one before; original areas decide."""
    t = V.track(spark, d).select("clip_id", "frame_idx", F.coalesce("value", F.lit(0.0)).alias("area"), "event_type").withColumn("collapsed", T.collapsed("area"))
    return t.select("clip_id", "frame_idx", "collapsed", F.when(F.col("collapsed"), F.lag("event_type").over(T.by_frame())).otherwise(F.col("event_type")).alias("payload"))


@query(sql.GRID + """, b as (select clip_id, frame_idx, min(x) filter (a > 200) as x0, min(y) filter (a > 200) as y0, max(x) filter (a > 200) + 1 as x1, max(y) filter (a > 200) + 1 as y1 from px group by all)
select clip_id, frame_idx, case when x0 is not null then greatest(0, x0 - round_even((x1 - x0) * 0.12e0, 0)::int) end as x0, case when x0 is not null then greatest(0, y0 - round_even((y1 - y0) * 0.12e0, 0)::int) end as y0,
case when x0 is not null then least(8, x1 + round_even((x1 - x0) * 0.12e0, 0)::int) end as x1, case when x0 is not null then least(8, y1 + round_even((y1 - y0) * 0.12e0, 0)::int) end as y1 from b""")
def seq_salient_box(spark, d):
    """The padded box around a frame's strong alpha; null where none is strong."""
    box = B.salient(F.col("x"), F.col("y"), F.col("a") > 200, F.lit(8), F.lit(8))
    return V.pixels(V.frames(spark, d)).groupBy("clip_id", "frame_idx").agg(*box)
