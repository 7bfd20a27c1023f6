"""Queries of job records, time estimates, settings, guards and set operations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framegrid.operators import service as S
from framegrid.operators import temporal as T
from framegrid.plans import sql
from framegrid.plans.queries import query
from framegrid.sources import proxies as V

# Job records


def record_texts(spark, d):
    """A JSON record per job; every thirteenth is cut off, clips lack ids or keep their output under its old name by turns."""
    c = V.clips(spark, d).where("job_id % 17 > 0")
    outputs = F.when(F.col("part") % 3 == 0, F.create_map(F.lit("gif"), F.concat(F.lit("o"), F.col("part").cast("string")))).when(F.col("part") % 3 == 1, F.create_map(F.lit("gif"), F.lit("old"), F.lit("primary"), F.lit("new")))
    clip = F.struct("clip_no", F.when(F.col("part") % 2 == 0, F.concat(F.lit("c"), F.col("clip_no").cast("string"))).alias("id"), F.when(F.col("status") == "failed", "running").otherwise(F.col("status")).alias("status"), outputs.alias("outputs"), F.when(F.col("part") % 5 == 0, F.array(F.lit("use_trimap"))).alias("auto_disabled"))
    held = c.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(clip), lambda x, y: x["clip_no"] - y["clip_no"]), lambda x: x.dropFields("clip_no")).alias("clips"))
    s = F.col("status")
    jobs = V.jobs(spark, d).withColumn("status", F.when((s == "queued") & (F.col("job_id") % 3 == 0), "waiting_gpu").otherwise(s)).join(held, "job_id", "left")
    text = F.to_json(F.struct(F.col("job_id").cast("string").alias("id"), "status", F.col("created_at").cast("string").alias("created_at"), "clips"))
    return jobs.select(F.when(F.col("job_id") % 13 == 0, F.substring(text, 1, 40)).otherwise(text).alias("text"))


@query(sql.JOBS + """, j as (select job_id, case when status = 'queued' and job_id % 3 = 0 then 'waiting_gpu' else status end as s from job where job_id % 13 > 0), c as (select * from clip where job_id % 17 > 0)
select job_id::varchar as job_id, case s when 'running' then 'failed' when 'waiting_gpu' then 'queued' else s end as status, case s when 'running' then 'E_SERVER_RESTART' end as code, case when part % 2 = 0 then 'c' || clip_no else lpad(clip_no::varchar, 2, '0') end as clip_id,
case when c.status = 'failed' then case when s = 'running' then 'failed' else 'running' end else c.status end as clip_status, case part % 3 when 0 then 'o' || part when 1 then 'new' end as "primary", case when part % 5 = 0 then 1 else 0 end as n_disabled from j left join c using (job_id)""")
def src_job_records(spark, d):
    """Records read with their schema, broken ones skipped, old ones filled up, restarts made good."""
    return S.restored(record_texts(spark, d)).select("job_id", "status", "code", "clip_id", "clip_status", "primary", F.size("auto_disabled").alias("n_disabled"))


@query(sql.JOBS + "select job_id, case when status = 'queued' then 'running' else status end as claimed, case when status = 'queued' then 'waiting_gpu' else status end as waiting from job")
def ops_claim_update(spark, d):
    j = V.jobs(spark, d).select("job_id", "status")
    return S.claimed(j).withColumnRenamed("status", "claimed").join(S.waiting(j).withColumnRenamed("status", "waiting"), "job_id")


@query(sql.JOBS + "select job_id, row_number() over (order by created_at desc, job_id desc) as place, count(clip_no) as n_clips from job left join clip using (job_id) group by job_id, created_at")
def ops_summary_list(spark, d):
    """The listing of all jobs: their records without settings, metrics, timings and outputs, newest first."""
    every = V.clips(spark, d).select("job_id", F.struct("clip_no", "status", F.col("work").alias("metrics"), F.col("fraction").alias("timings"), F.col("part").alias("outputs")).alias("c"))
    clips = every.groupBy("job_id").agg(F.collect_list("c").alias("clips"))
    light = F.transform("clips", lambda c: c.dropFields("metrics", "timings", "outputs"))
    jobs = V.jobs(spark, d).withColumn("day", F.to_date("created_at"))
    days = jobs.groupBy("day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per day
    k = F.row_number().over(W.partitionBy("day").orderBy(F.desc("created_at"), F.desc("job_id")))
    placed = jobs.withColumn("k", k).join(days.select("day", before.alias("before")), "day").join(clips, "job_id", "left")
    return placed.select("job_id", (F.col("before") + F.col("k")).alias("place"), F.coalesce(F.size(light), F.lit(0)).cast("long").alias("n_clips"))


# Time estimates


@query(sql.TRACK + """, u as (select distinct clip_id from track), s(grp, stage, seed) as (values ('cuda', 'detect', 0.12e0), ('cuda', 'matting', 0.31e0), ('cuda', 'despill', 0.25e0), ('cpu', 'detect', 0.75e0), ('cpu', 'matting', 35e0), ('cpu', 'despill', 0.25e0), ('postprocess:cpu', 'postprocess', 0.55e0), ('qc:cpu', 'qc', 0.15e0), ('key', 'key', 0.1e0),
('encode:supersampled_gif@4', 'encode', 1.9e0), ('encode:supersampled_gif@3', 'encode', 1.1e0), ('encode:supersampled_gif@2', 'encode', 0.5e0), ('encode:ss_alpha_gif@4', 'encode', 0.25e0), ('encode:mov', 'encode', 0.1e0), ('encode:webp', 'encode', 0.1e0))
select clip_id, grp, stage, case when clip_id % 3 = 0 then seed when grp = 'cuda' and stage = 'detect' then clip_id / 1000e0 when grp = 'cpu' and stage = 'despill' and clip_id % 3 = 2 then 0.5e0 else seed end as value from u, s
union all select clip_id, 'new', 'encode', 7e0 from u where clip_id % 3 = 1""")
def src_timing(spark, d):
    """Learned coefficients of every user, a third of them unreadable, over the seeds."""
    users = V.track(spark, d).select("clip_id").distinct()
    own = F.when(F.col("clip_id") % 3 == 0, '{"version":1,"coef":5').when(F.col("clip_id") % 3 == 1, F.format_string('{"version":1,"coef":{"cuda":{"detect":{"s_per_frame":%s,"n":3}},"new":{"encode":{"s_per_frame_mpix":7}},"cpu":{"despill":{"s_per_frame":9}}}}', (F.col("clip_id") / 1000.0).cast("string")))
    text = own.otherwise(F.format_string('{"coef":{"cuda":{"detect":{"s_per_frame":%s}},"cpu":{"despill":{"s_per_frame_mpix":0.5,"n":1}}}}', (F.col("clip_id") / 1000.0).cast("string")))
    return S.coefficients(users.withColumn("text", text), ["clip_id"])


def planned(spark, d):
    p = F.col("part")
    encoder = F.element_at(F.array(*map(F.lit, ("supersampled_gif", "ss_alpha_gif", "mov", "webp"))), (p % 4 + 1).cast("int"))
    return V.clips(spark, d).select(
        "job_id", "clip_no", F.when(p % 7 > 0, F.col("frames")).alias("frames"), F.when(p % 5 > 0, p * 3).alias("w"), F.lit(900).alias("h"), F.element_at(F.array(*map(F.lit, ("cuda", "cpu", "auto"))), (p % 3 + 1).cast("int")).alias("device"), encoder.alias("encoder"),
        (p % 9 % 4 + 1).alias("supersample"), (p % 2 == 0).alias("despill"), (F.col("frames") % 2).alias("half"), (F.col("fraction") < 0.05).alias("wants_qc"), (p % 6 == 0).alias("keyed"),
    )


@query(sql.JOBS + """, p as (select job_id, clip_no, case when part % 7 > 0 then frames else 120 end as f, case when part % 5 > 0 then part * 3 * 900 / 1e6 else 2e0 end as mp, part % 3 = 1 as cpu, part % 4 as e, part % 9 % 4 + 1 as ss, part % 2 = 0 as ds, frames % 2 as half, fraction < 0.05e0 as wq, part % 6 = 0 as k from clip),
q as (select *, case when k then 0.1e0 * f * mp else (case when cpu then 35.75e0 else 0.43e0 end) * f + case when ds then 0.25e0 * f * mp else 0 end end as infer, case when not k and half > 0 then 0.55e0 * f * mp else 0 end as postprocess,
(case when k then 0.25e0 when e = 0 then case ss when 4 then 1.9e0 when 3 then 1.1e0 when 2 then 0.5e0 else 0 end when e = 1 then 0.25e0 else 0.1e0 end) * f * mp as encode, case when wq then 0.15e0 * f * mp else 0 end as qc from p)
select job_id, clip_no, round(infer / 7.0001e0, 5) as infer, round(postprocess / 7.0001e0, 5) as postprocess, round(encode / 7.0001e0, 5) as encode, round(qc / 7.0001e0, 5) as qc, round((infer + postprocess + encode + qc) / 7.0001e0, 5) as total from q""")
def ops_predict(spark, d):
    """Predicted seconds by stage, over 7.0001, which lie on no rounding boundary."""
    out = S.predicted(planned(spark, d))
    return out.select("job_id", "clip_no", *(F.round(F.col(c) / 7.0001, 5).alias(c) for c in ("infer", "postprocess", "encode", "qc", "total")))


_ETA = sql.TRACK + """, k as (select clip_id, frame_idx as tick, least(3, frame_idx // 20) as s, (frame_idx % 20 + 1) / 20e0 as f, (frame_idx % 20) * (10 + clip_id % 90) / 7e2 as e from track),
w as (select *, ([2e0, 0.5e0, 1.5e0, 0.2e0])[s + 1] as p, ([2.2e0, 1.7e0, 0.2e0, 0e0])[s + 1] as later, greatest(0, least(1, (f - 0.1e0) / 0.4e0)) as m, greatest(0, e / f - e) as seen from k),
r as (select *, later + case when s <> 2 then case when f < 0.1e0 then greatest(0, p - e) else m * seen + (1 - m) * greatest(0, p - e) end
  when f >= 1 then greatest(0, p * 0.65e0 - greatest(0, e - p * 0.35e0)) else p * 0.65e0 + case when f < 0.1e0 then greatest(0, p * 0.35e0 - e) else m * seen + (1 - m) * greatest(0, p * 0.35e0 - e) end end as raw from w) """


def raw_eta(spark, d):
    """Ticks of three stages of twenty frames and a last one of all others, with the raw seconds left of the whole clip."""
    k = V.track(spark, d).select("clip_id", F.col("frame_idx").alias("tick"), F.least(F.lit(3), F.floor(F.col("frame_idx") / 20).cast("int")).alias("s"), ((F.col("frame_idx") % 20 + 1) / 20.0).alias("f"), ((F.col("frame_idx") % 20) * (10 + F.col("clip_id") % 90) / 7e2).alias("e"))
    at = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("s") + 1)
    rest = S.stage_remaining(at(*S.STAGES), F.col("f"), F.col("e"), at(2.0, 0.5, 1.5, 0.2))
    return k.select("clip_id", "tick", (at(2.2, 1.7, 0.2, 0.0) + rest).alias("raw"))


@query(_ETA + """, d as (select clip_id, tick, greatest(0, raw) as shown from r where tick = 0 union all select r.clip_id, r.tick, 0.7e0 * d.shown + 0.3e0 * least(greatest(0, r.raw), d.shown * 1.5e0) from d join r on r.clip_id = d.clip_id and r.tick = d.tick + 1)
select clip_id, tick, round(raw, 9) as raw, round(shown, 9) as shown from d join r using (clip_id, tick)""")
def ops_eta_smooth(spark, d):
    raw = raw_eta(spark, d)
    return T.smoothed_eta(raw).join(raw, ["clip_id", "tick"]).select("clip_id", "tick", F.round("raw", 9).alias("raw"), F.round("remaining", 9).alias("shown"))


@query(sql.JOBS + """, s(k, stage, base, weight) as (values (0, 'prepare', 0e0, 0.02e0), (1, 'infer', 0.02e0, 0.53e0), (2, 'post', 0.55e0, 0.10e0), (3, 'encode', 0.65e0, 0.30e0), (4, 'qc', 0.95e0, 0.05e0))
select job_id, clip_no, stage, round(case when part % 2 = 0 then base + weight * fraction when stage <> 'qc' then (base + weight * fraction) / 0.95e0 end, 6) as overall from clip join s on k = part % 5""")
def ops_stage_fraction(spark, d):
    """Progress over all stages, of every other clip without the last one."""
    stage = F.element_at(F.array(*map(F.lit, S.WEIGHTS)), (F.col("part") % 5 + 1).cast("int"))
    c = V.clips(spark, d).withColumn("stage", stage)
    return c.select("job_id", "clip_no", "stage", F.round(S.overall_fraction(F.col("stage"), F.col("fraction"), F.col("part") % 2 == 0), 6).alias("overall"))


@query(sql.JOBS + "select job_id, clip_no, case when part % 3 = 2 then 'cuda' else ['cuda', 'cpu'][part % 3 + 1] end as infer_group, 'encode:' || case part % 4 when 0 then 'supersampled_gif@' || (part % 9 % 4 + 1) when 1 then 'ss_alpha_gif@4' when 2 then 'mov' else 'webp' end as encode_group from clip")
def ops_groups(spark, d):
    return planned(spark, d).select("job_id", "clip_no", S.infer_group(F.col("device")).alias("infer_group"), S.encode_group(F.col("encoder"), F.col("supersample")).alias("encode_group"))


# Settings


@query(sql.JOBS + """, q as (select job_id, clip_no, part, frames, fraction, ['instant', 'quick', 'thorough', 'odd'][part % 4 + 1] as mode, (part % 400) / 400e0 as sc, frames * 10 - 20 as th, part % 3 = 0 as has_enc, part % 5 = 0 as has_qc, part % 2 = 0 as has_side from clip),
g as (select *, mode = 'odd' as bad_mode, not (sc between 0.2e0 and 1e0) or not (th between 0 and 255) or (has_side and part % 6 <> 0 and not (part % 5000 between 256 and 4096)) or (has_enc and frames % 7 = 0) as bad from q)
select job_id, clip_no, case when bad_mode then 'E_BAD_MODE' when bad then 'E_BAD_OVERRIDE' end as code, case when not bad_mode and not bad then case when has_enc then 'webp' when mode = 'instant' then 'ss_alpha_gif' end end as encoder,
case when not bad_mode and not bad then case when has_side then case when part % 6 = 0 then 'null' else (part % 5000)::varchar end when mode = 'instant' then '1000' end end as max_side, case when not bad_mode and not bad then case when part % 7 = 0 then 'cuda' else 'cpu' end end as device,
case when not bad_mode and not bad then has_enc::varchar end as explicit, case when not bad_mode and not bad then case when has_qc then part % 10 = 0 else mode = 'thorough' end end as run_qc from g""")
def ops_settings(spark, d):
    """Modes and overrides of every clip merged and checked."""
    p = F.col("part")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    text = lambda v: F.lit(f'"{v}"')
    pairs = F.array(
        pair("scale", p % 400 / 400.0), pair("alpha_threshold", F.col("frames") * 10 - 20), F.when(p % 3 == 0, pair("encoder", F.when(F.col("frames") % 7 == 0, text("gif")).otherwise(text("webp")))),
        F.when(p % 5 == 0, pair("qc", p % 10 == 0)), F.when(p % 2 == 0, pair("max_side", F.when(p % 6 == 0, "null").otherwise((p % 5000).cast("string")))), F.when(p % 7 == 0, pair("device", text("cuda"))),
    )
    asked = V.clips(spark, d).select("job_id", "clip_no", F.element_at(F.array(*map(F.lit, ("instant", "quick", "thorough", "odd"))), (p % 4 + 1).cast("int")).alias("mode"), F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull())).alias("overrides"))
    out = S.settings(asked)
    return out.select("job_id", "clip_no", "code", *(F.col("config")[k].alias(n) for k, n in (("encoder", "encoder"), ("max_side", "max_side"), ("device", "device"), ("encoder_explicit", "explicit"))), "run_qc")


@query(sql.JOBS + "select job_id, clip_no, case when part % 3 = 0 then array_to_string(list_filter([case when part % 2 = 0 then 'apply_clears' end, case when part % 5 = 0 then 'strip_bg_fringe' end, 'use_trimap'], lambda x: x is not null), ',') else '' end as disabled from clip")
def ops_auto_disabled(spark, d):
    p = F.col("part")
    config = F.create_map(F.lit("apply_clears"), (p % 2 == 0).cast("string"), F.lit("strip_bg_fringe"), (p % 5 == 0).cast("string"), F.lit("use_trimap"), F.lit("true"))
    flat = F.when(p % 3 == 0, F.lit(False)).when(p % 3 == 1, F.lit(True))
    return V.clips(spark, d).select("job_id", "clip_no", F.array_join(S.auto_disabled(flat, config), ",").alias("disabled"))


@query(sql.JOBS + """select job_id, clip_no, case when fraction * 10 % 2 >= 1 then 0.5e0 when part % 3 = 0 then 1e0 else least(1e0, 1000e0 / greatest(part * 3, 900)) end as scale, greatest(2, round_even(sqrt(pow(part * 3, 2) + pow(900, 2)) * 0.005e0, 0))::int as radius,
case when part * 30 * 9000 / 1e6 > 50 and part % 2 = 0 then 'E_TOO_LARGE' end as size_code, case when work * 10 < frames * 1000e0 * 1.5e0 then 'E_DISK_SPACE' end as disk_code from clip""")
def ops_sizes(spark, d):
    """Scale and radius of a clip, and its codes for frames too large and a disk too full."""
    p, w, h = F.col("part"), F.col("part") * 3, F.lit(900)
    scale = F.when(F.col("fraction") * 10 % 2 >= 1, 0.5).otherwise(1.0)
    radius = F.greatest(F.lit(2), F.rint(F.hypot(w, h) * 0.005).cast("int"))
    return V.clips(spark, d).select("job_id", "clip_no", S.scale_of(scale, F.when(p % 3 > 0, 1000.0), w, h).alias("scale"), radius.alias("radius"), S.frame_size_code(p * 30, F.lit(9000), p % 2 == 1).alias("size_code"), S.disk_code(F.col("work") * 10, F.col("frames") * 1000.0).alias("disk_code"))


# Client rules


@query(sql.JOBS + """select job_id, clip_no, replace(replace(case when part % 3 = 0 then 'Clip {{n}} of {{job}}: {{n}}' when part % 3 = 1 then 'Takt {{n}}' else 'progress.odd' end, '{{n}}', clip_no::varchar), '{{job}}', job_id::varchar) as text, case when part % 2 = 0 then 'webp' else 'gif' end as format,
case when part % 2 = 0 then 1 else 0 end + case when part % 5 < 2 then 1 else 0 end as n_clean, part % 4 <> 3 as video from clip""")
def str_client_rules(spark, d):
    """Texts by language with parameters, overrides cleaned, output formats, and which files look like video."""
    p = F.col("part")
    key = F.when(p % 3 == 2, "progress.odd").when(p % 3 == 1, "progress.old").otherwise("progress")
    own, fallback = F.create_map(F.lit("progress"), F.lit("Clip {{n}} of {{job}}: {{n}}")), F.create_map(F.lit("progress"), F.lit("?"), F.lit("progress.old"), F.lit("Takt {{n}}"))
    params = F.create_map(F.lit("n"), F.col("clip_no").cast("string"), F.lit("job"), F.col("job_id").cast("string"))
    raw = F.create_map(F.lit("encoder"), F.when(p % 2 == 0, "webp").otherwise("avi"), F.lit("device"), F.when(p % 5 == 0, "cpu").when(p % 5 == 1, "auto").otherwise("tpu"), F.lit("odd"), F.lit("1"))
    valid = {"device": ("cuda", "cpu", "auto"), "encoder": ("supersampled_gif", "ss_alpha_gif", "mov", "webp")}
    clean = F.map_filter(raw, lambda k, v: ((k == "device") & v.isin(*valid["device"])) | ((k == "encoder") & v.isin(*valid["encoder"])))
    kept = F.coalesce(clean["encoder"], F.lit("gif"))
    name = F.element_at(F.array(*map(F.lit, ("a.MP4", "b.bin", "c.webm", "d.txt"))), (p % 4 + 1).cast("int"))
    kind = F.when(p % 4 == 1, "video/x-odd").otherwise("application/x")
    video = name.rlike(r"(?i)\.(mp4|mov|webm)$") | kind.startswith("video/")
    return V.clips(spark, d).select("job_id", "clip_no", S.interpolated(key, own, fallback, params).alias("text"), F.when(kept.isin("webp", "mov"), kept).otherwise("gif").alias("format"), F.size(clean).alias("n_clean"), video.alias("video"))


@query(sql.JOBS + "select c.job_id, c.clip_no, c.status, case when c.clip_no < 2 and c.job_id % 2 = 0 then c.part end as preview from clip c")
def ops_reconnect(spark, d):
    """A new snapshot keeps what the client had; clips that the client had and the snapshot hasn't are dropped."""
    c = V.clips(spark, d)
    old = c.where("clip_no < 2 and job_id % 2 = 0").select("job_id", "clip_no", F.col("part").alias("preview"))
    gone = old.limit(1).select(F.lit(-1).cast("long").alias("job_id"), "clip_no", "preview")
    return S.merged_snapshot(c.select("job_id", "clip_no", "status"), old.unionByName(gone), ["preview"])


@query(sql.JOBS + "select job_id, clip_no, 'clip' || clip_no || '.gif' as path from clip where status = 'done' and part % 2 = 0")
def ops_download_allowed(spark, d):
    """Of the files asked for only those that a finished clip put out."""
    c = V.clips(spark, d)
    path = F.concat(F.lit("clip"), F.col("clip_no").cast("string"), F.lit(".gif"))
    outputs = c.where("status = 'done'").select("job_id", F.explode(F.array(path, F.concat(path, F.lit(".json")))).alias("path"))
    asked = c.where("part % 2 = 0").select("job_id", "clip_no", F.explode(F.array(path, F.concat(F.lit("../"), path))).alias("path"))
    return asked.join(outputs, ["job_id", "path"], "left_semi").select("job_id", "clip_no", "path")


# Sets, limits, firsts


@query(sql.JOBS + """, a as (select distinct part from clip where status = 'done'), b as (select distinct part from clip where status = 'failed')
select 'both' as kind, part from (select part from a intersect select part from b) union all select 'either', part from (select part from a union select part from b) union all select 'only done', part from (select part from a except select part from b)""")
def set_operations(spark, d):
    c = V.clips(spark, d)
    a, b = (c.where(F.col("status") == s).select("part") for s in ("done", "failed"))
    named = lambda df, k: df.select(F.lit(k).alias("kind"), "part")
    return named(a.intersect(b), "both").union(named(a.union(b).distinct(), "either")).union(named(a.subtract(b), "only done"))


@query(sql.JOBS + "select job_id, clip_no, case when frames < 40 then frames end as frames, case when frames >= 40 then 'E_INPUT_TOO_LONG' end as code from clip")
def set_uploads(spark, d):
    """Accepted and rejected uploads in one table, of different columns."""
    c = V.clips(spark, d).select("job_id", "clip_no", "frames")
    refused = c.where("frames >= 40").select("job_id", "clip_no", F.lit("E_INPUT_TOO_LONG").alias("code"))
    return c.where("frames < 40").unionByName(refused, allowMissingColumns=True)


@query(sql.TRACK + "select clip_id, frame_idx, value from track")
def lim_frames(spark, d):
    """All frames of clips that are short enough; a longer clip is an error, never cut."""
    return S.guarded(V.track(spark, d).select("clip_id", "frame_idx", "value"), 100_000)


@query(sql.JOBS + "select job_id, min(clip_no) as first_clip, arg_min(part, clip_no) as part, count(distinct part % 10) as n_kinds, array_to_string(list_sort(list(distinct part % 10)), ',') as kinds from clip where status = 'pending' group by 1")
def top_first_pending(spark, d):
    """A job's first pending clip, and the different kinds of its pending ones."""
    kinds = F.array_join(F.array_sort(F.collect_set(F.col("part") % 10)), ",")
    return V.clips(spark, d).where("status = 'pending'").groupBy("job_id").agg(F.min("clip_no").alias("first_clip"), F.min_by("part", "clip_no").alias("part"), F.count_distinct(F.col("part") % 10).alias("n_kinds"), kinds.alias("kinds"))


@query(sql.GRID + """, ar as (select clip_id, frame_idx, count(*) filter (a > 127) as n, sum(a) as s from px group by all)
select clip_id, arg_max(frame_idx, (n, -frame_idx)) as frame_idx from ar group by 1 union select clip_id, arg_max(frame_idx, (s, -frame_idx)) from ar group by 1""")
def top_worst_frames(spark, d):
    """The worst frames by either of two measures, each once."""
    ar = V.pixels(V.frames(spark, d)).groupBy("clip_id", "frame_idx").agg(F.count_if(F.col("a") > 127).alias("n"), F.sum("a").alias("s"))
    worst = [ar.groupBy("clip_id").agg(T.worst(c).alias("frame_idx")) for c in ("n", "s")]
    return worst[0].union(worst[1]).distinct()


@query("with e as (select date_trunc('minute', ts) as t, event_type, max(value) as v from events group by all), s as (select t, sum(v) as v from e group by 1) select date_trunc('day', t)::varchar as day, round(max(v), 6) as peak from s group by 1")
def agg_polled_peak(spark, d):
    """The day's peak of a sum over sources, each polled by the minute."""
    e = V.table(spark, d, "events").groupBy(F.date_trunc("minute", "ts").alias("t"), "event_type").agg(F.max("value").alias("v"))
    s = e.groupBy("t").agg(F.sum("v").alias("v"))
    return s.groupBy(F.date_format(F.date_trunc("day", "t"), "yyyy-MM-dd HH:mm:ss").alias("day")).agg(F.round(F.max("v"), 6).alias("peak"))


@query(sql.JOBS + """select job_id, clip_no, '{"job_id":' || job_id || ',"clip_no":' || clip_no || ',"frames":' || frames || ',"status":"' || status || '"}' as config, rpad('clip' || clip_no, 12, ' ') || lpad(frames::varchar, 8, ' ') || lpad(case when part % 4 = 0 then '-' else part::varchar end, 8, ' ') as line from clip""")
def snk_report(spark, d):
    """Settings beside the output as JSON, and the lines of the text table; a missing measure is a dash."""
    config = F.to_json(F.struct("job_id", "clip_no", "frames", "status"))
    cell = F.coalesce(F.when(F.col("part") % 4 > 0, F.col("part")).cast("string"), F.lit("-"))
    line = F.concat(F.rpad(F.concat(F.lit("clip"), F.col("clip_no").cast("string")), 12, " "), F.lpad(F.col("frames").cast("string"), 8, " "), F.lpad(cell, 8, " "))
    return V.clips(spark, d).select("job_id", "clip_no", config.alias("config"), line.alias("line"))


@query(sql.JOBS + ", k as (select job_id, count(*) as packets from clip where status <> 'failed' group by 1) select job_id, case when job_id % 3 > 0 then job_id % 500 else packets end as frames, case when job_id % 4 = 0 then 30e0 else (job_id % 60)::double end as fps from job left join k using (job_id)")
def src_clip_metadata(spark, d):
    """Frame counts from the container, else by counting packets, null if there are none; 30 frames a second where none is told."""
    packets = V.clips(spark, d).where("status <> 'failed'").groupBy("job_id").agg(F.count("*").alias("packets"))
    told = F.when(F.col("job_id") % 3 > 0, F.col("job_id") % 500)
    fps = F.when(F.col("job_id") % 4 > 0, (F.col("job_id") % 60).cast("double"))
    return V.jobs(spark, d).join(packets, "job_id", "left").select("job_id", F.coalesce(told, "packets").alias("frames"), F.coalesce(fps, F.lit(30.0)).alias("fps"))


@query("select n_nationkey, split_part('chroma_' || lower(n_name) || '_x', '_', 2) || substr('chroma_' || lower(n_name) || '_x', length('chroma_' || split_part('chroma_' || lower(n_name) || '_x', '_', 2)) + 1) as short_name, case when n_regionkey < 3 then 'set' || n_regionkey end as known_set from nation")
def src_fixture_names(spark, d):
    """Short names of named clips, and the set that holds them, null for unknown sets."""
    key = F.concat(F.lit("chroma_"), F.lower("n_name"), F.lit("_x"))
    sets = spark.createDataFrame([(k, f"set{k}") for k in range(3)], "n_regionkey int, known_set string")
    n = V.table(spark, d, "nation")
    return n.join(F.broadcast(sets), "n_regionkey", "left").select("n_nationkey", F.regexp_extract(key, "^[^_]*_(.*)$", 1).alias("short_name"), "known_set")
