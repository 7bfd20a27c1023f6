"""Queries of mattes from crops, and of contact sheets, each beside its SQL; the red channel stands for a model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.operators import crops as C
from framegrid.operators import evaluate as E
from framegrid.operators import keyer as K
from framegrid.operators import matte as M
from framegrid.operators import sheet
from framegrid.operators.store import written
from framegrid.plans import sql
from framegrid.plans.evaluation import _ALL, MARGIN, RING, SEARCH
from framegrid.plans.matte import _COMP, CLEAR, levels, plain
from framegrid.plans.queries import query
from framegrid.sources import proxies as V

MARGIN_OF_CROP = 0.25


def red():
    """The model: alpha is the red channel."""
    return lambda rgb: rgb[..., 0] / 255.0


def boxed(spark, d):
    """Frames with boxes; every seventh or so has none."""

    def place(rgb, a):
        x = a.ravel().astype(int)
        return {"x0": float(x[1] % 3), "y0": float(x[2] % 3), "x1": float(5 + x[3] % 4), "y1": float(5 + x[4] % 4), "none": bool(x[5] % 7 == 0)}

    frames = written(plain(spark, d))
    boxes = P.map_packed(frames, place, "x0 double, y0 double, x1 double, y1 double, none boolean")
    box = F.when(~F.col("none"), F.struct("x0", "y0", "x1", "y1")).alias("box")
    return frames.join(boxes.select("clip_id", "frame_idx", box), ["clip_id", "frame_idx"])


def _rect(table: str, name: str) -> str:
    """Crops (rx0, rx1, ry0, ry1) of the boxes of a table, wider by a quarter; all of the frame without a box."""
    return f"""{name} as materialized (select *, case when x0 is null then 0 else greatest(0, trunc(x0)::int - trunc((trunc(x1) - trunc(x0)) * 0.25e0)::int) end as rx0, case when x0 is null then 8 else least(8, trunc(x1)::int + trunc((trunc(x1) - trunc(x0)) * 0.25e0)::int) end as rx1,
  case when x0 is null then 0 else greatest(0, trunc(y0)::int - trunc((trunc(y1) - trunc(y0)) * 0.25e0)::int) end as ry0, case when x0 is null then 8 else least(8, trunc(y1)::int + trunc((trunc(y1) - trunc(y0)) * 0.25e0)::int) end as ry1 from {table})"""


def _cut(table: str, name: str) -> str:
    """Whether the subject touches an edge of the crop that isn't the frame's."""
    return f"""{name} as materialized (select k.clip_id, k.frame_idx, bool_or(p.r > 127 and ((p.y = ry0 and ry0 > 0) or (p.y = ry1 - 1 and ry1 < 8) or (p.x = rx0 and rx0 > 0) or (p.x = rx1 - 1 and rx1 < 8))) and any_value(x0) is not null as cut
  from {table} k join px p on p.clip_id = k.clip_id and p.frame_idx = k.frame_idx and p.x >= rx0 and p.x < rx1 and p.y >= ry0 and p.y < ry1 group by k.clip_id, k.frame_idx)"""


_CROPS = sql.GRID + """, bx as (select clip_id, frame_idx, case when data[6] % 7 > 0 then (data[2] % 3)::double end as x0, case when data[6] % 7 > 0 then (data[3] % 3)::double end as y0, case when data[6] % 7 > 0 then (5 + data[4] % 4)::double end as x1, case when data[6] % 7 > 0 then (5 + data[5] % 4)::double end as y1 from fr),
""" + _rect("bx", "c1") + ", " + _cut("c1", "t1")


@query(_CROPS + """select px.clip_id, px.frame_idx, px.y, px.x, case when cut or (x >= rx0 and x < rx1 and y >= ry0 and y < ry1) then r else 0 end as a, cut as truncated, case when cut then 2 else 1 end as passes from px join c1 using (clip_id, frame_idx) join t1 using (clip_id, frame_idx)""")
def matte_cropped(spark, d):
    """Mattes of the crops; where a crop cuts the subject off, of the whole frame."""
    out = written(C.cropped(boxed(spark, d), red, MARGIN_OF_CROP, None))
    return levels(out).join(out.select("clip_id", "frame_idx", "truncated", "passes"), ["clip_id", "frame_idx"])


@query(_CROPS + """, h as (select clip_id, frame_idx, coalesce((frame_idx - lag(frame_idx) over (partition by clip_id order by frame_idx) > 4)::int, 0) as new from t1 where cut),
ru as (select clip_id, min(frame_idx)::int as lo, max(frame_idx)::int as hi from (select clip_id, frame_idx, sum(new) over (partition by clip_id order by frame_idx) as run from h) group by clip_id, run),
un as (select ru.clip_id, lo, hi, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from ru join bx on bx.clip_id = ru.clip_id and frame_idx between lo and hi group by all),
gr as (select clip_id, lo, hi, greatest(0, (x0 + x1) / 2 - (x1 - x0) * 0.75e0) as x0, greatest(0, (y0 + y1) / 2 - (y1 - y0) * 0.75e0) as y0, least(8e0, (x0 + x1) / 2 + (x1 - x0) * 0.75e0) as x1, least(8e0, (y0 + y1) / 2 + (y1 - y0) * 0.75e0) as y1 from un),
ag as (select fr.clip_id, fr.frame_idx, x0, y0, x1, y1 from fr join gr on gr.clip_id = fr.clip_id and fr.frame_idx between lo and hi), """ + _rect("ag", "c2") + ", " + _cut("c2", "t2") + """
select px.clip_id, px.frame_idx, px.y, px.x, case when c2.clip_id is null then case when x >= c1.rx0 and x < c1.rx1 and y >= c1.ry0 and y < c1.ry1 then r else 0 end when t2.cut or (x >= c2.rx0 and x < c2.rx1 and y >= c2.ry0 and y < c2.ry1) then r else 0 end as a,
  case when c2.clip_id is null then 1 when t2.cut then 3 else 2 end as passes
from px join c1 using (clip_id, frame_idx) left join c2 on c2.clip_id = px.clip_id and c2.frame_idx = px.frame_idx left join t2 on t2.clip_id = px.clip_id and t2.frame_idx = px.frame_idx""")
def seq_repair_mattes(spark, d):
    """Runs of frames whose crop cut the subject off, matted again in a grown box, or whole where that is cut off too."""
    frames = boxed(spark, d)
    first = written(C.cropped(frames, red, MARGIN_OF_CROP, None, fallback=False))
    out = written(C.repaired(frames, first, red, MARGIN_OF_CROP, None))
    return levels(out).join(out.select("clip_id", "frame_idx", "passes"), ["clip_id", "frame_idx"])


@query(sql.GRID + ", fg as materialized (select clip_id, frame_idx, y, x, y * 8 + x as p, r from px where a > 127)" + _COMP + """,
isl as (select clip_id, frame_idx, label, count(*) as area, count(*) filter (g >= 128) / count(*)::double as verdict from lab join (select clip_id, frame_idx, y, x, g from px) q using (clip_id, frame_idx, y, x) group by all having count(*) >= 6)
select clip_id, frame_idx, label, area, round(1 - verdict, 6) as verdict from isl""")
def matte_zoomed(spark, d):
    """Every island's share that a second look at a window around it calls backdrop; the green channel stands for the model."""
    rules = CLEAR | {"sat": 256.0, "core": 0}
    look = C.zoomed_verdict(lambda: lambda rgb: rgb[..., 1] / 255.0, least=4, times=1, side=None)
    return M.islands(plain(spark, d), look, rules).select("clip_id", "frame_idx", "label", "area", F.round("verdict", 6).alias("verdict"))


@query(_ALL + """, pk as (select clip_id, arg_max(frame_idx, (f1i, -frame_idx)) as i from pf where flat group by 1 union select clip_id, arg_max(frame_idx, (s1, -frame_idx)) from ps group by 1),
ti as (select clip_id, i, row_number() over (partition by clip_id order by i) - 1 as k from pk)
select sc.clip_id, sc.y, (sc.x + 8 * k)::int as x, floor(round(a / 255e0 * r + (1 - a / 255e0) * 255, 9))::int as r, floor(round(a / 255e0 * g, 9))::int as g, floor(round(a / 255e0 * b + (1 - a / 255e0) * 255, 9))::int as b from sc join ti on ti.clip_id = sc.clip_id and ti.i = sc.frame_idx""")
def snk_sheet(spark, d):
    """The frames with the most erased inside and the most chatter of every clip, side by side over magenta."""
    scenes = written(V.scenes(spark, d))
    stats = written(K.scaled(K.backdrop(scenes, RING)))
    joined = E.fitted(scenes, scenes)
    erased = E.frame_metrics(K._with_model(joined, stats), MARGIN).join(stats.where("flat").select("clip_id"), "clip_id", "left_semi")
    picks = erased.groupBy("clip_id").agg(E.worst("f1i").alias("frame_idx")).union(E.pair_metrics(joined, 12, **SEARCH).groupBy("clip_id").agg(E.worst("s1").alias("frame_idx")))
    made = sheet.sheets(scenes, picks)
    return P.unpack(made.withColumn("frame_idx", F.lit(0)), {"rgb": 3}).drop("frame_idx")
