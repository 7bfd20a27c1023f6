"""Queries of the versioned job table, of validated jobs and of events to subscribers, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framegrid.operators import service as S
from framegrid.operators.jobtable import JobTable, validated
from framegrid.operators.store import shared_folder
from framegrid.plans import sql
from framegrid.plans.queries import query
from framegrid.sources import proxies as V
from framegrid.streaming import events as E


@query(sql.JOBS + """, q as (select job_id, status, row_number() over (order by created_at, job_id) as k from job where status = 'queued'),
t as (select job_id, case when k <= 5 then 'running' when k = 7 then 'cancelled' else job.status end as status, k from job left join q using (job_id))
select job_id, status, coalesce(k <= 5, false) as started from t where job_id <> (select min(job_id) from job where status = 'done') and coalesce(k, 0) <> 8""")
def ops_job_table(spark, d):
    """All jobs after two claimers took three and two of them, one was cancelled and two were deleted."""
    jobs = V.jobs(spark, d).select("job_id", "status", "created_at").withColumn("started_at", F.lit(None).cast("timestamp"))
    one, two = (JobTable(spark, root) for root in [f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"] * 2)
    one.create(jobs)
    waiting = [r["job_id"] for r in jobs.where("status = 'queued'").orderBy("created_at", "job_id").select("job_id").limit(8).collect()]
    one.claim(most=3)
    two.claim(most=2)
    if len(waiting) == 8:
        one.cancel(waiting[6])
        two.delete(waiting[7])
    one.delete(jobs.where("status = 'done'").agg(F.min("job_id")).first()[0])
    return two.read().select("job_id", "status", F.col("started_at").isNotNull().alias("started"))


_UPLOADS = sql.JOBS + """, up as (select job_id, clip_no, case part % 6 when 0 then 'avi' when 1 then 'MP4' when 2 then 'webm' else 'mov' end as ext, part % 700 as mb, case when part % 11 > 0 then frames * 40 end as frames, 30.0::double as fps, part * 2 as w, frames * 50 as h from clip),
co as (select job_id, clip_no, case when lower(ext) not in ('mp4', 'mov', 'webm') then 'E_INPUT_EXT' when mb > 500 then 'E_INPUT_TOO_LARGE' when frames is null or frames <= 0 or w <= 0 or h <= 0 then 'E_INPUT_UNREADABLE'
  when frames / fps > 60 or frames > 1800 then 'E_INPUT_TOO_LONG' when greatest(w, h) > 4096 or frames * w * h / 1e6::double > 3800 then 'E_INPUT_TOO_LARGE' end as code from up) """


def uploads(spark, d):
    """Clips as uploads of which many break a rule."""
    p = F.col("part")
    ext = F.when(p % 6 == 0, "avi").when(p % 6 == 1, "MP4").when(p % 6 == 2, "webm").otherwise("mov")
    return V.clips(spark, d).select("job_id", "clip_no", ext.alias("ext"), (p % 700).alias("mb"), F.when(p % 11 > 0, F.col("frames") * 40).alias("frames"), F.lit(30.0).alias("fps"), (p * 2).alias("w"), (F.col("frames") * 50).alias("h"), F.concat(F.lit("in/"), F.col("clip_no").cast("string")).alias("input"))


def _code():
    return S.admission_code(*(F.col(c) for c in ("ext", "mb", "frames", "fps", "w", "h")))


@query(_UPLOADS + "select job_id, case when count(*) filter (code is null) > 0 then 'queued' else 'failed' end as status, case when count(*) filter (code is null) = 0 then 'E_INPUT_UNREADABLE' end as code, count(*) filter (code is null) as n_pending, count(*) as n_clips from co group by 1")
def ops_create_validated(spark, d):
    """New jobs by what their clips' validation left."""
    return validated(uploads(spark, d), _code())[0]


@query(_UPLOADS + "select job_id, clip_no, code, case when code is null then 'pending' else 'failed' end as status, case when code is null then 'in/' || clip_no end as input from co")
def ops_create_clips(spark, d):
    """The clips of new jobs: rejected ones have failed and lost their input."""
    return validated(uploads(spark, d), _code())[1].select("job_id", "clip_no", "code", "status", "input")


@query(sql.JOBS + """, ev as (select job_id, 0 as at, 'queued' as status, 'new' as body from job union all select job_id, 2 * (clip_no + 1), 'running', status from clip union all select job_id, 1000, case status when 'done' then 'done' else 'running' end, 'end' from job),
su as (select job_id, p as at, s as subscriber from job, (values (-1, 'early'), (1, 'first'), (3, 'second'), (1001, 'late')) t(p, s)),
lt as (select su.job_id, subscriber, su.at, arg_max(ev.status, ev.at) as status, arg_max(ev.body, ev.at) as body from su left join ev on ev.job_id = su.job_id and ev.at < su.at group by all)
select job_id, subscriber, 0::bigint as n, case when status is null then 'missing' else 'snapshot' end as kind, coalesce(status, 'failed') as status, body from lt
union all select lt.job_id, subscriber, row_number() over (partition by lt.job_id, subscriber order by ev.at), 'event', ev.status, ev.body from lt join ev on ev.job_id = lt.job_id and ev.at > lt.at where lt.status in ('queued', 'running')""")
def ops_event_stream(spark, d):
    """What four subscribers of every job are sent: one too early, two while it runs, one when it is over."""
    jobs, clips = V.jobs(spark, d), V.clips(spark, d)
    text, none = "string", F.lit(None).cast("string")
    at = lambda v: F.lit(v).cast("long").alias("at")
    new = jobs.select("job_id", at(0), none.alias("subscriber"), F.lit("queued").alias("status"), F.lit("new").alias("body"))
    runs = clips.select("job_id", (2 * (F.col("clip_no") + 1)).cast("long").alias("at"), none.alias("subscriber"), F.lit("running").alias("status"), F.col("status").alias("body"))
    ends = jobs.select("job_id", at(1000), none.alias("subscriber"), F.when(F.col("status") == "done", "done").otherwise("running").alias("status"), F.lit("end").alias("body"))
    listen = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("at"), F.lit(s).alias("subscriber")) for p, s in ((-1, "early"), (1, "first"), (3, "second"), (1001, "late")))))
    who = jobs.select("job_id", listen.alias("l")).select("job_id", "l.at", "l.subscriber", F.lit(None).cast(text).alias("status"), F.lit(None).cast(text).alias("body"))
    sent = E.subscribed(new.union(runs).union(ends).union(who))
    return sent.select("job_id", "subscriber", "n", "kind", F.json_tuple(F.expr("substr(message, 7)"), "status", "body").alias("status", "body"))
