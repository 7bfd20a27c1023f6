"""Queries of inputs of networks, detector boxes, ramps, corners and previews, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.functions import pixel
from framegrid.operators import detection as D
from framegrid.operators import keyer as K
from framegrid.operators import matte as M
from framegrid.operators import sheet
from framegrid.plans import sql
from framegrid.plans.evaluation import _ALL, RING
from framegrid.plans.matte import plain
from framegrid.plans.queries import _long, query
from framegrid.sources import proxies as V


@query(sql.GRID + "select clip_id, frame_idx, y, x, round((r / 255e0 - 0.485e0) / 0.229e0, 6) as r, round((g / 255e0 - 0.456e0) / 0.224e0, 6) as g, round((b / 255e0 - 0.406e0) / 0.225e0, 6) as b from px")
def pix_normalised(spark, d):
    """Colours as the matting network takes them."""
    px = V.colours(spark, d)
    names = ("r", "g", "b")
    return px.select("clip_id", "frame_idx", "y", "x", *(F.round(c, 6).alias(n) for c, n in zip(pixel.normalised(*map(F.col, names)), names)))


@query(sql.GRID + """, co as (select clip_id, (y > 5)::int * 2 + (x > 5)::int as corner, avg(r) as r, avg(g) as g, avg(b) as b from px where frame_idx = 0 and (y < 2 or y > 5) and (x < 2 or x > 5) group by all)
select clip_id, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b from co group by 1""")
def src_corner_colour(spark, d):
    """The backdrop's colour by the mean of the four corners' means in a clip's first frame."""
    px = V.colours(spark, d).where("frame_idx = 0 and (y < 2 or y > 5) and (x < 2 or x > 5)")
    corners = px.groupBy("clip_id", (F.col("y") > 5).alias("low"), (F.col("x") > 5).alias("right")).agg(*(F.avg(c).alias(c) for c in ("r", "g", "b")))
    return corners.groupBy("clip_id").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("r", "g", "b")))


_RAW = sql.JOBS + """, raw as (select job_id as frame, clip_no as det, part % 640 as cx, part * 7 % 640 as cy, frames * 6 as bw, frames * 4 + 3 as bh, 1 - fraction * 4 as objectness, [fraction * 10, (part % 10) / 10e0, 0.35e0] as scores, 300 + part % 900 as w, 200 + job_id % 700 as h from clip),
rr as (select *, least(640 / h::double, 640 / w::double) as f, list_max(scores) as top from raw) """


@query(_RAW + """select frame, det, list_position(scores, top)::int - 1 as cls, round(objectness * top, 6) as conf, round((cx - bw / 2e0) / f, 9) as x0, round((cy - bh / 2e0) / f, 9) as y0, round((cx + bw / 2e0) / f, 9) as x1, round((cy + bh / 2e0) / f, 9) as y1, round_even(w * f, 0)::int as nw, round_even(h * f, 0)::int as nh
from rr where round(objectness * top, 9) > 0.25e0""")
def sel_decoded_boxes(spark, d):
    """A detector's output over a letterboxed frame as boxes of the frame."""
    p, n, f = F.col("part"), F.col("frames"), F.col("fraction")
    raw = V.clips(spark, d).select(
        F.col("job_id").alias("frame"), F.col("clip_no").alias("det"), (p % 640).alias("cx"), (p * 7 % 640).alias("cy"), (n * 6).alias("bw"), (n * 4 + 3).alias("bh"), F.round(1 - f * 4, 9).alias("objectness"),
        F.array(f * 10, (p % 10) / 10.0, F.lit(0.35)).alias("scores"), (300 + p % 900).alias("w"), (200 + F.col("job_id") % 700).alias("h"),
    )
    factor, nw, nh = D.letterbox(F.col("w"), F.col("h"))
    out = D.decoded(raw.withColumns({"factor": factor, "nw": nw, "nh": nh}), F.col("factor"), 0.25 + 1e-12)
    return out.select("frame", "det", "cls", "nw", "nh", F.round("conf", 6).alias("conf"), *(F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(_ALL + """, md as (select p.clip_id, p.frame_idx, p.y, p.x, median(q.d) as d, bool_and(q.a / 255e0 > 0.9e0) as f_in, bool_or(q.a / 255e0 > 0.1e0) as f_out
  from (select *, sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) as d from su join st using (clip_id)) p join (select *, sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) as d from su join st using (clip_id)) q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 1 group by p.clip_id, p.frame_idx, p.y, p.x),
cr as (select p.clip_id, p.frame_idx, p.y, p.x, bool_and(q.a / 255e0 > 0.9e0) as f_in, bool_or(q.a / 255e0 > 0.1e0) as f_out from sc p join sc q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 1 group by p.clip_id, p.frame_idx, p.y, p.x)
select clip_id, frame_idx, y, x, round(case when cr.f_in then 1e0 when not cr.f_out then 0e0 else greatest(0, least(1, (d - 3) / 5)) end, 6) as t from md join cr using (clip_id, frame_idx, y, x)""")
def matte_trimap_ramp(spark, d):
    """Trimaps whose unsure part follows the distance from the backdrop; the parts are narrowed by a square, corners included."""
    scenes = V.scenes(spark, d)
    held = K._with_model(scenes, K.scaled(K.backdrop(scenes, RING)))
    return _long(M.trimaps(held, 1, ramp=True, element=P.square).withColumnRenamed("t", "data"), "t").withColumn("t", F.round("t", 6))


@query(sql.GRID + """, w as (select oy, ox, y, x, greatest(0, least((oy + 1) * 8, (y + 1) * 5) - greatest(oy * 8, y * 5)) * greatest(0, least((ox + 1) * 8, (x + 1) * 5) - greatest(ox * 8, x * 5)) as u from range(5) a(oy), range(5) b(ox), range(8) c(y), range(8) e(x))
select clip_id, frame_idx, oy::int as y, ox::int as x, round_even(sum(a * u) / 64e0, 0)::int as a, round_even(sum(r * u) / 64e0, 0)::int as r, round_even(sum(g * u) / 64e0, 0)::int as g, round_even(sum(b * u) / 64e0, 0)::int as b from px join w using (y, x) where u > 0 group by all""")
def snk_preview(spark, d):
    """Frames as previews of at most five pixels a side."""
    return P.unpack(sheet.previews(plain(spark, d), 5), {"a": 1, "rgb": 3})
