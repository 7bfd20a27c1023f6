"""Further queries over the proxy views: detections, job updates, presets, manifests, summaries; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framegrid.operators import detection as D
from framegrid.operators import service as S
from framegrid.plans import sql
from framegrid.plans.queries import query
from framegrid.sources import proxies as V

# Detections: a clip is a frame, its fields give a box

_DET = sql.JOBS + ", det as (select job_id as frame, clip_no as det, part % 800 as x0, frames * 10 as y0, part % 800 + 40 + part % 97 * 4 as x1, frames * 10 + 30 + part % 89 * 5 as y1, case when part % 3 = 0 then 1 else 0 end as cls, fraction * 10 as conf from clip)"


def detections(spark, d):
    """(frame, det, x0, y0, x1, y1, cls, conf)."""
    p, n = F.col("part"), F.col("frames")
    box = ((p % 800).alias("x0"), (n * 10).alias("y0"), (p % 800 + 40 + p % 97 * 4).alias("x1"), (n * 10 + 30 + p % 89 * 5).alias("y1"))
    return V.clips(spark, d).select(F.col("job_id").alias("frame"), F.col("clip_no").alias("det"), *box, F.when(p % 3 == 0, 1).otherwise(0).alias("cls"), (F.col("fraction") * 10).alias("conf"))


@query(_DET + """, r as (select *, row_number() over (partition by frame order by cls, (x1 - x0) * (y1 - y0) desc, det) as k from det where conf >= 0.25e0)
select frame, case when cls = 0 and conf >= 0.8e0 or (x1 - x0) * (y1 - y0) >= 0.05e0 * 1000 * 1000 then det end as det from r where k = 1""")
def sel_subject_box(spark, d):
    return D.subject_box(detections(spark, d), ["frame"], 1000 * 1000)


@query(_DET + """, g as (select frame, det, x0, y0, x1, y1, (x1 - x0) * 0.12e0 as mx, (y1 - y0) * 0.12e0 as my from det)
select frame, det, greatest(0, trunc(x0 - mx))::int as x0, greatest(0, trunc(y0 - my))::int as y0, least(1000, trunc(x1 + mx))::int as x1, least(1000, trunc(y1 + my))::int as y1,
greatest(512, 5 * greatest(x1 - x0, y1 - y0))::int as side from g""")
def sel_box_geometry(spark, d):
    b = detections(spark, d)
    grown = D.grow(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 0.12, 1000, 1000)
    return b.select("frame", "det", *grown, D.zoom_side(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("side"))


@query(_DET.replace("with ", "with recursive ", 1) + """, o as materialized (select frame, det, x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1, row_number() over (partition by frame order by conf desc, det) as k from det where conf >= 0.25e0),
g as (select frame, k, [{'det': det, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] as kept from o where k = 1 union all
  select o.frame, o.k, case when len(list_filter(g.kept, lambda b: i(b) / ((b.x1 - b.x0) * (b.y1 - b.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - i(b)) > 0.45e0)) > 0 then g.kept else list_append(g.kept, {'det': o.det, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}) end
  from g join o on o.frame = g.frame and o.k = g.k + 1)
select frame, unnest(arg_max(kept, k)).det as det from g group by frame""".replace("i(b)", "(greatest(0, least(b.x1, o.x1) - greatest(b.x0, o.x0)) * greatest(0, least(b.y1, o.y1) - greatest(b.y0, o.y0)))"))
def sel_non_maximum(spark, d):
    return D.non_maximum(detections(spark, d), ["frame"])


# Job updates


@query(sql.JOBS + "select j.job_id, case when bool_or(c.status = 'pending') then 'queued' else 'failed' end as status, count(*) filter (c.status = 'pending') as n_pending from job j left join clip c using (job_id) group by 1")
def ops_create(spark, d):
    return S.created(V.jobs(spark, d), V.clips(spark, d))


@query(sql.JOBS + "select job_id, row_number() over (order by created_at, job_id) as place from job where status = 'queued'")
def ops_claim_order(spark, d):
    """The places of all queued jobs in the order in which they are claimed: by days, counted first, and within a day."""
    queued = V.jobs(spark, d).where("status = 'queued'").withColumn("day", F.to_date("created_at"))
    days = queued.groupBy("day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per day
    within = F.row_number().over(W.partitionBy("day").orderBy("created_at", "job_id"))
    return queued.withColumn("k", within).join(days.select("day", before.alias("before")), "day").select("job_id", (F.col("before") + F.col("k")).alias("place"))


@query(sql.JOBS + "select job_id, status, created_at from job where status = 'queued'")
def ops_claim_queue(spark, d):
    """All queued jobs in the order in which they are claimed."""
    return V.jobs(spark, d).where("status = 'queued'").orderBy("created_at", "job_id").select("job_id", "status", "created_at")


@query(sql.JOBS + """select c.job_id, c.clip_no, case when j.status = 'queued' and c.status = 'pending' then 'cancelled' else c.status end as clip_status, case when j.status = 'queued' then 'cancelled' else j.status end as job_status, j.status = 'running' as asked
from clip c join job j using (job_id)""")
def ops_cancel(spark, d):
    return S.cancelled(V.jobs(spark, d), V.clips(spark, d))


@query(sql.JOBS + "select job_id, clip_no from clip where part % 7 > 0")
def ops_retry(spark, d):
    """Of every seventh part the input is gone."""
    return S.retried(V.clips(spark, d).withColumn("input", F.when(F.col("part") % 7 > 0, F.col("part")))).select("job_id", "clip_no")


@query(sql.JOBS + "select job_id, clip_no, part as input from clip where part is not null")
def ops_retry_inputs(spark, d):
    """A clip's part stands for its input file."""
    return S.retried(V.clips(spark, d).withColumn("input", F.col("part")))


@query(sql.JOBS + """, e as (select job_id, case part % 3 when 0 then 'E_CUDA_OOM' when 1 then 'E_PIPELINE' else 'E_INPUT_TOO_LONG' end as code from clip where status = 'failed')
select job_id, case when count(distinct code) = 1 then min(code) else 'E_PIPELINE' end as code, n || ' of ' || m || ' failed' as detail from e join (select job_id, count(*) filter (status = 'failed') as n, count(*) as m from clip group by 1) using (job_id) group by job_id, n, m""")
def ops_error_rollup(spark, d):
    code = F.element_at(F.array(F.lit("E_CUDA_OOM"), F.lit("E_PIPELINE"), F.lit("E_INPUT_TOO_LONG")), (F.col("part") % 3 + 1).cast("int"))
    return S.error_rollup(V.clips(spark, d).withColumn("code", F.when(F.col("status") == "failed", code)))


@query(sql.JOBS + "select job_id, clip_no, case when fraction * 100 < 3 then 'wait' else 'run' end as gate, case when frames / 20e0 > 1.5e0 and part % 2 = 0 and fraction < 0.05e0 then 'webp' else 'gif' end as encoder from clip")
def ops_gates(spark, d):
    c = V.clips(spark, d)
    gate = S.gpu_gate((F.col("fraction") * 100).cast("double"), F.lit(3.0))
    return c.select("job_id", "clip_no", gate.alias("gate"), S.encoder_under_load(F.col("frames") / 20.0, F.lit("gif"), F.col("part") % 2 == 1, F.col("fraction") >= 0.05).alias("encoder"))


def given_overrides(clips):
    """(job_id, clip_no, field, value): four overrides of every clip."""
    given = F.create_map(F.lit("k"), (F.col("fraction") * 10).cast("string"), F.lit("max_side"), (F.col("part") % 5000).cast("string"), F.lit("qc"), F.when(F.col("part") % 2 == 0, "true").otherwise("maybe"), F.lit("nope"), F.lit("1"))
    return clips.select("job_id", "clip_no", F.explode(given).alias("field", "value"))


def override_rules(spark):
    return spark.createDataFrame([("k", "number", 0.05, 0.9), ("max_side", "number", 64.0, 4096.0), ("qc", "flag", None, None)], "field string, kind string, low double, high double")


@query(sql.JOBS + """, o as (select job_id, clip_no, unnest(['k', 'max_side', 'qc', 'nope']) as field, unnest([(fraction * 10)::varchar, (part % 5000)::varchar, case when part % 2 = 0 then 'true' else 'maybe' end, '1']) as value from clip)
select job_id, clip_no, field, case field when 'k' then case when value::double between 0.05e0 and 0.9e0 then null else 'E_BAD_OVERRIDE' end when 'max_side' then case when value::double between 64 and 4096 then null else 'E_BAD_OVERRIDE' end when 'qc' then case when value in ('true', 'false') then null else 'E_BAD_OVERRIDE' end else 'E_BAD_OVERRIDE' end as code from o""")
def ops_overrides(spark, d):
    return S.override_codes(given_overrides(V.clips(spark, d)), override_rules(spark)).select("job_id", "clip_no", "field", "code")


@query(sql.JOBS + """, o as (select job_id, clip_no, unnest(['k', 'max_side', 'qc', 'nope']) as field, unnest([(fraction * 10)::varchar, (part % 5000)::varchar, case when part % 2 = 0 then 'true' else 'maybe' end, '1']) as value from clip)
select job_id, clip_no, field, case field when 'k' then case when value::double between 0.05e0 and 0.9e0 then null else 'E_BAD_OVERRIDE' end when 'max_side' then case when value::double between 64 and 4096 then null else 'E_BAD_OVERRIDE' end when 'qc' then case when value in ('true', 'false') then null else 'E_BAD_OVERRIDE' end else 'E_BAD_OVERRIDE' end as code from o""")
def ops_overrides_all(spark, d):
    """The overrides of every clip."""
    return S.override_codes(given_overrides(V.clips(spark, d)), override_rules(spark)).select("job_id", "clip_no", "field", "code")


@query(sql.JOBS + """select c.job_id, 'job' || c.job_id || '/clip' || clip_no || e.ext as member from clip c join job j using (job_id), (values ('.gif'), ('.json')) e(ext) where c.status = 'done' and j.status = 'done'""")
def snk_manifest(spark, d):
    clips = V.clips(spark, d).where("status = 'done'").join(V.jobs(spark, d).where("status = 'done'").select("job_id"), "job_id", "left_semi")
    name = F.concat(F.lit("clip"), F.col("clip_no").cast("string"))
    outputs = F.create_map(F.lit("gif"), F.concat(F.lit("/srv/out/"), name, F.lit(".gif")), F.lit("report"), F.concat(F.lit("/srv/out/"), name, F.lit(".json")))
    return S.bundle(clips.select("job_id", F.concat(F.lit("job"), F.col("job_id").cast("string")).alias("stem"), outputs.alias("outputs")))


@query(sql.JOBS + "select job_id, clip_no, greatest(1, round_even(w * least(1e0, 360e0 / greatest(w, h)), 0))::int as pw, greatest(1, round_even(h * least(1e0, 360e0 / greatest(w, h)), 0))::int as ph from (select *, part * 3 as w, frames * 30 as h from clip)")
def snk_preview_size(spark, d):
    w, h = F.col("part") * 3, F.col("frames") * 30
    return V.clips(spark, d).select("job_id", "clip_no", *S.preview_size(w, h))


# Sequences


@query(sql.TRACK + "select clip_id, any_value(h) as plan_key from (select clip_id, sha256(clip_id || '|' || count(*) || '|smoothed|15') as h from track group by clip_id) group by 1")
def seq_plan_key(spark, d):
    n = V.track(spark, d).groupBy("clip_id").agg(F.count("*").alias("n"))
    return n.select("clip_id", S.plan_key(F.col("clip_id"), F.col("n"), F.lit("smoothed"), F.lit(15)).alias("plan_key"))


@query("select user_id, count(*) as runs, max(n)::bigint as longest from (select user_id, run, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as run from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as new from events)) group by all) group by 1")
def extra_sessions(spark, d):
    e = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query(sql.JOBS + ", k as (select job_id, clip_no, frames, sum(frames) over (partition by job_id order by clip_no) - frames as base from clip) select job_id, lpad(clip_no::varchar, 2, '0') as clip, base::bigint as base from k")
def ops_stage_bases(spark, d):
    before = W.partitionBy("job_id").orderBy("clip_no").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("frames").over(before), F.lit(0))
    name = F.col("clip_no").cast("string")
    return V.clips(spark, d).select("job_id", F.lpad(name, 2, "0").alias("clip"), base.alias("base"))
