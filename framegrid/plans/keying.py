"""Queries of the keyer as a whole over the packed scenes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.operators import keyer as K
from framegrid.plans import sql
from framegrid.plans.queries import query
from framegrid.sources import proxies as V

#: The scenes are small: a border of two pixels, and far is a fifth of the side.
RING, FAR = 2, 0.2


def models(spark, d):
    return K.key_models(V.scenes(spark, d), ring=RING, far=FAR)


@query(sql.KEYED + """select clip_id, flat, safe, round(mu_u, 6) as mu_u, round(mu_v, 6) as mu_v, round(sd_u, 6) as sd_u, round(sd_v, 6) as sd_v, round(share, 6) as share, bg_r, bg_g, bg_b, round(saturation, 6) as saturation, round(neutral, 6) as neutral,
round(p999, 6) as p999, round(t_lo, 6) as t_lo, round(t_hi, 6) as t_hi, case when not flat then 'backdrop is not flat (' || printf('%.4f', share) || ' of the border is like it)' when saturation < 20 then 'backdrop is flat but nearly neutral (saturation ' || printf('%.1f', saturation) || ')' else 'flat backdrop of saturation ' || printf('%.0f', saturation) end as reason from km""")
def key_model(spark, d):
    """Sampled frames, border statistics, far backdrop, thresholds and the verdict of every clip."""
    names = ["mu_u", "mu_v", "sd_u", "sd_v", "share", "saturation", "neutral", "p999", "t_lo", "t_hi"]
    return models(spark, d).select("clip_id", "flat", "safe", "bg_r", "bg_g", "bg_b", "reason", *(F.round(n, 6).alias(n) for n in names))


_KEY = sql.KEYED + """, kd as materialized (select su.*, km.*, sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) as d from su join km using (clip_id)),
ka as materialized (select *, greatest(0, least(1, (d - t_lo) / (t_hi - t_lo))) as al, greatest(0, least(1, (d - t_lo) / greatest(neutral - t_lo, t_hi - t_lo))) as cov from kd), """


def _solved(band: str, cover: str) -> str:
    one = lambda c: f"case when {band} then floor(greatest(0, least(255, round(({c} - (1 - {cover}) * bg_{c}) / {cover}, 9))))::int else {c} end as {c}"
    return ", ".join(map(one, "rgb"))


@query(_KEY + f"""ne as (select p.clip_id, p.frame_idx, p.y, p.x, bool_or(q.al < 0.996e0) as near from ka p join ka q on p.clip_id = q.clip_id and p.frame_idx = q.frame_idx and (abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 2 or abs(p.y - q.y) = 2 and p.x = q.x) group by all)
select clip_id, frame_idx, y, x, round_even(al * 255, 0)::int as a, {_solved("near and al > 0.004e0 and cov < 0.996e0", "greatest(cov, 0.004e0)")} from ka join ne using (clip_id, frame_idx, y, x)""")
def key_alpha(spark, d):
    """All frames keyed by the models of their clips, colours unmixed by estimated coverage."""
    return P.unpack(K.key(V.scenes(spark, d), models(spark, d)), {"a": 1, "rgb": 3})


@query(_KEY + f"""o as (select 1) select clip_id, frame_idx, y, x, round_even(al * 255, 0)::int as a, {_solved("al > 0.004e0 and al < 0.996e0", "al")} from ka""")
def key_alpha_plain(spark, d):
    """The same with colours unmixed by alpha itself."""
    return P.unpack(K.key(V.scenes(spark, d), models(spark, d), coverage=False), {"a": 1, "rgb": 3})


@query(sql.SCENE + """, nf as (select clip_id, count(*) as n from fr group by 1), ks as (select distinct clip_id, least(n - 1, round_even(i * n / 5e0, 0))::int as frame_idx from nf, range(5) r(i)),
sp as materialized (select * from su semi join ks using (clip_id, frame_idx))""" + sql.backdrop("sp") + ", cl as (select distinct clip_id from fr union all select -1) select cl.clip_id, flat, round(saturation, 6) as saturation, round(share, 6) as share, coalesce(flat and saturation >= 20, false) as keyable from cl left join st using (clip_id)")
def src_backdrop_probe(spark, d):
    """The backdrop of five frames of an upload; a clip of which no frame can be read has nulls and isn't keyable."""
    scenes = V.scenes(spark, d)
    clips = scenes.select("clip_id").distinct().union(spark.createDataFrame([(-1,)], "clip_id int"))
    probe = K.scaled(K.backdrop(K.sample(scenes, K.upload_places), RING))
    out = clips.join(probe, "clip_id", "left").withColumn("keyable", K.keyable(F.col("flat"), F.col("saturation")))
    return out.select("clip_id", "flat", "keyable", F.round("saturation", 6).alias("saturation"), F.round("share", 6).alias("share"))
