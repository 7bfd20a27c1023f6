"""Job, clip, progress and time-estimate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Admission limits, stage weights, seeds in seconds a frame, error codes.
LIMITS = {"max_mb": 500, "max_s": 60, "max_frames": 1800, "max_side": 4096, "max_mpix_frames": 3800}
EXTENSIONS = ("mp4", "mov", "webm")
WEIGHTS = {"prepare": 0.02, "infer": 0.53, "post": 0.10, "encode": 0.30, "qc": 0.05}
SEEDS = {"detect": 0.12, "matting": 0.31, "despill": 0.25, "postprocess": 0.55, "qc": 0.15}
WAITS = ("queued", "waiting_gpu")
TERMINAL = ("done", "failed", "cancelled")


def admission_code(ext: Column, mb: Column, frames: Column, fps: Column, w: Column, h: Column) -> Column:
    """The code of the first rule that an upload breaks, or null."""
    seconds = F.when(fps > 0, frames / F.when(fps > 0, fps).otherwise(1.0)).otherwise(0.0)
    return (
        F.when(~F.coalesce(F.lower(ext).isin(*EXTENSIONS), F.lit(False)), "E_INPUT_EXT")
        .when(mb > LIMITS["max_mb"], "E_INPUT_TOO_LARGE")
        .when(frames.isNull() | (frames <= 0) | (w <= 0) | (h <= 0), "E_INPUT_UNREADABLE")
        .when((seconds > LIMITS["max_s"]) | (frames > LIMITS["max_frames"]), "E_INPUT_TOO_LONG")
        .when((F.greatest(w, h) > LIMITS["max_side"]) | (frames * w * h / 1e6 > LIMITS["max_mpix_frames"]), "E_INPUT_TOO_LARGE")
    )


def final_status(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """(job_id, status, n_failed, n_clips) of finished jobs (job_id, asked); ``asked`` is whether cancelling was asked for.

    Cancelled if it was and no clip succeeded; done if any did, or if none was even begun; else
    failed, as are jobs without clips.
    """
    n = clips.groupBy("job_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") != "pending").alias("begun"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count("*").alias("n_clips"))
    zero = F.lit(0).cast("long")
    held = jobs.select("job_id", "asked").join(n, "job_id", "left").select("job_id", "asked", *(F.coalesce(c, zero).alias(c) for c in ("done", "begun", "n_failed", "n_clips")))
    whole = (F.col("done") > 0) | (F.col("begun") == 0)
    status = F.when(F.col("asked") & (F.col("done") == 0), "cancelled").when(whole & (F.col("n_clips") > 0), "done").otherwise("failed")
    return held.select("job_id", status.alias("status"), "n_failed", "n_clips")


def job_progress(clips: DataFrame) -> DataFrame:
    """(job_id, percent): mean over clips, terminal ones counting as whole."""
    part = F.when(F.col("status").isin(*TERMINAL), 1.0).otherwise(F.col("fraction"))
    return clips.groupBy("job_id").agg(F.round(100 * F.avg(part), 6).alias("percent"))


def stage_bases(weights: dict[str, float] = WEIGHTS, qc: bool = True) -> list[tuple[str, float, float]]:
    """(stage, base, weight), weights adding up to 1."""
    used = {k: v for k, v in weights.items() if qc or k != "qc"}
    total, base, out = sum(used.values()), 0.0, []
    for k, v in used.items():
        out.append((k, base, v / total))
        base += v / total
    return out


def retention(created: Column, now: Column, status: Column, keep_days: int = 14, input_days: int = 1) -> Column:
    """delete, prune or keep; unfinished jobs are kept."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86400e6
    return F.when(~status.isin(*TERMINAL), "keep").when(age > keep_days, "delete").when(age > input_days, "prune").otherwise("keep")


def error_code(kind: Column, message: Column) -> Column:
    """The code of the first rule that a failure's kind or message fits."""
    m = F.lower(message)
    return (
        F.when(kind == "cancelled", "E_CANCELLED")
        .when(kind == "too_long", "E_INPUT_TOO_LONG")
        .when((kind == "timeout") | m.contains("ffmpeg timeout"), "E_ENCODE_TIMEOUT")
        .when(m.rlike("failed to allocate|cuda_error_out_of_memory|cudamalloc"), "E_CUDA_OOM")
        .when(m.contains("out of memory") & m.rlike("cuda|cudnn|cublas|onnxruntime|gpu"), "E_CUDA_OOM")
        .otherwise("E_PIPELINE")
    )


def sanitize(text: Column, cap: int = 500) -> Column:
    """Absolute paths reduced to their last part, then cut to ``cap`` characters and an ellipsis."""
    bare = F.regexp_replace(text, r"(?:/[\w.\-]+)+/([\w.\-]+)", "$1")
    return F.when(F.length(bare) > cap, F.concat(F.left(bare, F.lit(cap)), F.lit("…"))).otherwise(bare)


def dedupe_names(df: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """``unique_name``: the k-th of equal names within the keys becomes "stem (k).ext"."""
    k = F.row_number().over(W.partitionBy(*keys, name).orderBy(*order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("_k", k).withColumn("unique_name", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_k").cast("string"), F.lit(")"), ext))).drop("_k")


def predicted_seconds(frames: Column, mpix: Column, coef: dict[str, Column]) -> dict[str, Column]:
    """Seconds by stage: by frame for detection and matting, by frame and megapixel for the rest."""
    return {k: frames * c * (F.lit(1.0) if k in ("detect", "matting") else mpix) for k, c in coef.items()}


def blended_remaining(fraction: Column, elapsed: Column, predicted: Column) -> Column:
    """Remaining seconds: the prediction's up to a tenth done, the observed rate's from half done, mixed between."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (fraction - 0.1) / 0.4))
    seen = F.when(fraction > 0, elapsed * (1 - fraction) / F.when(fraction > 0, fraction).otherwise(1.0)).otherwise(predicted)
    return w * seen + (1 - w) * F.greatest(F.lit(0.0), predicted - elapsed)


def clock(seconds: Column, hours: float = 3600) -> Column:
    """h:mm:ss from ``hours`` seconds on, else m:ss; rounded down."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(seconds >= hours, F.concat(h.cast("string"), F.lit(":"), pad(m), F.lit(":"), pad(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), pad(r)))


def about(seconds: Column) -> Column:
    """"about N s", "min" or "h", rounded up."""
    unit = F.when(seconds < 60, "s").when(seconds < 3600, "min").otherwise("h")
    n = F.ceil(seconds / F.when(seconds < 60, 1.0).when(seconds < 3600, 60.0).otherwise(3600.0))
    return F.concat(F.lit("about "), n.cast("string"), F.lit(" "), unit)


def backoff_ms(attempt: Column) -> Column:
    return F.least(1000 * F.pow(F.lit(2.0), attempt), F.lit(10000.0)).cast("long")


def created(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """(job_id, status, n_pending): a job is queued if any of its clips is pending, else failed; also one without clips."""
    n = clips.groupBy("job_id").agg(F.count_if(F.col("status") == "pending").alias("n"))
    pending = F.coalesce("n", F.lit(0).cast("long"))
    return jobs.select("job_id").join(n, "job_id", "left").select("job_id", F.when(pending > 0, "queued").otherwise("failed").alias("status"), pending.alias("n_pending"))


def cancelled(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """(job_id, clip_no, clip_status, job_status, asked): waiting jobs and their pending clips end at once, running ones are asked to stop."""
    waits = F.col("_job").isin(*WAITS)
    both = clips.join(jobs.select("job_id", F.col("status").alias("_job")), "job_id")
    clip = F.when(waits & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status"))
    return both.select("job_id", "clip_no", clip.alias("clip_status"), F.when(waits, "cancelled").otherwise(F.col("_job")).alias("job_status"), (F.col("_job") == "running").alias("asked"))


def retried(clips: DataFrame) -> DataFrame:
    """(job_id, clip_no, input) of all clips whose input is still there, whatever became of the clip or its job."""
    return clips.where("input is not null").select("job_id", "clip_no", "input")


def error_rollup(clips: DataFrame) -> DataFrame:
    """(job_id, code, detail) of jobs with failures: their only code, else the general one."""
    failed = F.col("status") == "failed"
    one = F.when(F.min("code") == F.max("code"), F.min("code")).otherwise("E_PIPELINE")
    n = clips.groupBy("job_id").agg(one.alias("code"), F.count_if(failed).alias("n"), F.count("*").alias("m"))
    return n.where("n > 0").select("job_id", "code", F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("m").cast("string"), F.lit(" failed")).alias("detail"))


def gpu_gate(free_mb: Column, need_mb: Column) -> Column:
    """wait or run; unknown memory passes."""
    return F.when(free_mb < need_mb, "wait").otherwise("run")


def encoder_under_load(ratio: Column, encoder: Column, explicit: Column, keyable: Column, most: float = 1.5) -> Column:
    """The encoder, or the light one on a loaded host where nobody asked for it by name."""
    return F.when((ratio > most) & ~explicit & ~keyable, "webp").otherwise(encoder)


def override_codes(given: DataFrame, rules: DataFrame) -> DataFrame:
    """``given`` (field, value) with ``code``: null where a rule (field, kind, low, high) of the field takes the value.

    Rules are a fixed table of a few rows.
    """
    number = F.expr("try_cast(value as double)")
    fits = F.when(F.col("kind") == "number", number.between(F.col("low"), F.col("high"))).when(F.col("kind") == "flag", F.col("value").isin("true", "false"))
    return given.join(F.broadcast(rules), "field", "left").withColumn("code", F.when(~F.coalesce(fits, F.lit(False)), "E_BAD_OVERRIDE")).drop("kind", "low", "high")


def bundle(outputs: DataFrame) -> DataFrame:
    """(job_id, member): the outputs' file names below the job's stem."""
    each = outputs.select("job_id", "stem", F.explode("outputs").alias("kind", "path"))
    return each.select("job_id", F.concat("stem", F.lit("/"), F.substring_index("path", "/", -1)).alias("member"))


def preview_size(w: Column, h: Column, edge: int = 360) -> tuple[Column, Column]:
    """Width and height with a long edge of at most ``edge``; never enlarged."""
    scale = F.least(F.lit(1.0), edge / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), F.rint(x * scale).cast("int")).alias(n) for x, n in ((w, "pw"), (h, "ph")))


def plan_key(*parts: Column) -> Column:
    """Name of a stage's stored rows: a digest of all that they depend on."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


# Job records

CLIP = "struct<id:string,name:string,status:string,outputs:map<string,string>,auto_disabled:array<string>,predicted_s:double>"
RECORD = f"id string, status string, created_at string, clips array<{CLIP}>, broken string"


def restored(texts: DataFrame, text: str = "text") -> DataFrame:
    """(job_id, status, code, created_at, clip_id, clip_status, primary, auto_disabled, predicted_s), a row per clip, of job records in JSON.

    Records that can't be read, or that have no id, are skipped.  Missing clip ids are their
    places, an output kept as ``gif`` is the primary one, missing lists are empty.  What was
    running failed by the restart, what waited is queued again.  A job without clips has one row
    with nulls.
    """
    parsed = texts.select(F.from_json(text, RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("j")).select("j.*")
    whole = parsed.where("broken is null and id is not null")
    ran = F.col("status") == "running"
    each = whole.select(F.col("id").alias("job_id"), "created_at", "status", F.posexplode_outer("clips").alias("place", "clip"))
    primary = F.coalesce(F.col("clip.outputs")["primary"], F.col("clip.outputs")["gif"])
    clip_status = F.when(ran & (F.col("clip.status") == "running"), "failed").otherwise(F.col("clip.status"))
    return each.select(
        "job_id", F.when(ran, "failed").when(F.col("status") == "waiting_gpu", "queued").otherwise(F.col("status")).alias("status"), F.when(ran, "E_SERVER_RESTART").alias("code"), "created_at",
        F.when(F.col("place").isNotNull(), F.coalesce("clip.id", F.lpad(F.col("place").cast("string"), 2, "0"))).alias("clip_id"), clip_status.alias("clip_status"), primary.alias("primary"),
        F.coalesce("clip.auto_disabled", F.array().cast("array<string>")).alias("auto_disabled"), F.col("clip.predicted_s").alias("predicted_s"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``restored`` of all job.json files below the folders of ``path``; each file is one record."""
    return restored(spark.read.text(f"{path}/*/job.json", wholetext=True), "value")


def claimed(jobs: DataFrame) -> DataFrame:
    """``jobs`` with waiting ones running; others as they are (the conditional update of a claim)."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*WAITS), "running").otherwise(F.col("status")))


def waiting(jobs: DataFrame) -> DataFrame:
    """``jobs`` with queued ones waiting for the device; others as they are."""
    return jobs.withColumn("status", F.when(F.col("status") == "queued", "waiting_gpu").otherwise(F.col("status")))


# Time estimates

# Seeds in seconds a frame (detect, matting) or a frame and megapixel, by group and stage, and what an unprobed clip counts as.
SEED_TABLE = (
    ("cuda", "detect", 0.12), ("cuda", "matting", 0.31), ("cuda", "despill", 0.25),
    ("cpu", "detect", 0.75), ("cpu", "matting", 35.0), ("cpu", "despill", 0.25),
    ("postprocess:cpu", "postprocess", 0.55), ("qc:cpu", "qc", 0.15), ("key", "key", 0.10),
    ("encode:supersampled_gif@4", "encode", 1.9), ("encode:supersampled_gif@3", "encode", 1.1), ("encode:supersampled_gif@2", "encode", 0.5),
    ("encode:ss_alpha_gif@4", "encode", 0.25), ("encode:mov", "encode", 0.1), ("encode:webp", "encode", 0.1),
)
DEFAULT_FRAMES, DEFAULT_MPIX = 120, 2.0
PER_FRAME = ("detect", "matting")
STAGES = ("infer", "postprocess", "encode", "qc")
COEF = "coef map<string,map<string,map<string,double>>>"


def infer_group(device: Column) -> Column:
    return F.when(device.isin("cuda", "cpu"), device).otherwise("cuda")


def encode_group(encoder: Column, supersample: Column) -> Column:
    return F.when(encoder == "supersampled_gif", F.concat(F.lit("encode:supersampled_gif@"), supersample.cast("string"))).when(encoder == "ss_alpha_gif", "encode:ss_alpha_gif@4").otherwise(F.concat(F.lit("encode:"), encoder))


def coefficients(learned: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, grp, stage, value): the learned coefficients of every JSON document, where it has none the seeds.

    A document that can't be read, or of another shape, counts as empty; groups and stages that
    only it has are kept.
    """
    spark = learned.sparkSession
    seeds = spark.createDataFrame(list(SEED_TABLE), "grp string, stage string, seed double")
    docs = learned.select(*keys, F.from_json(text, COEF).alias("j"))
    groups = docs.select(*keys, F.explode(F.coalesce("j.coef", F.create_map().cast("map<string,map<string,map<string,double>>>"))).alias("grp", "stages"))
    field = F.when(F.col("stage").isin(*PER_FRAME), F.col("fields")["s_per_frame"]).otherwise(F.col("fields")["s_per_frame_mpix"])
    seen = groups.select(*keys, "grp", F.explode("stages").alias("stage", "fields")).select(*keys, "grp", "stage", field.alias("seen")).where("seen is not null")
    wanted = docs.select(*keys).crossJoin(F.broadcast(seeds))  # fifteen rows
    both = wanted.join(seen, [*keys, "grp", "stage"], "full")
    return both.select(*keys, "grp", "stage", F.coalesce("seen", "seed").alias("value"))


def predicted(clips: DataFrame) -> DataFrame:
    """``clips`` with infer, postprocess, encode, qc and total: predicted seconds by the seeds.

    ``clips`` has frames, w, h, device, encoder, supersample, despill, half, wants_qc and keyed;
    unknown sizes count as defaults.  A keyed clip runs no inference and no postprocessing and
    takes the light encoder.
    """
    seed = F.create_map(*(F.lit(x) for g, s, v in SEED_TABLE for x in (f"{g}/{s}", v)))
    coef = lambda group, stage: F.coalesce(seed[F.concat(group, F.lit(f"/{stage}"))], F.lit(0.0))
    frames = F.when(F.coalesce(F.col("frames"), F.lit(0)) != 0, F.col("frames")).otherwise(DEFAULT_FRAMES)
    known = (F.coalesce(F.col("w"), F.lit(0)) != 0) & (F.coalesce(F.col("h"), F.lit(0)) != 0)
    area = frames * F.when(known, F.col("w") * F.col("h") / 1e6).otherwise(DEFAULT_MPIX)
    group = infer_group(F.col("device"))
    infer = (coef(group, "detect") + coef(group, "matting")) * frames + F.when(F.col("despill"), coef(group, "despill") * area).otherwise(0.0)
    encoder = F.when(F.col("keyed"), "encode:ss_alpha_gif@4").otherwise(encode_group(F.col("encoder"), F.col("supersample")))
    out = clips.withColumns({
        "infer": F.when(F.col("keyed"), coef(F.lit("key"), "key") * area).otherwise(infer),
        "postprocess": F.when(~F.col("keyed") & (F.col("half") > 0), coef(F.lit("postprocess:cpu"), "postprocess") * area).otherwise(0.0),
        "encode": coef(encoder, "encode") * area,
        "qc": F.when(F.col("wants_qc"), coef(F.lit("qc:cpu"), "qc") * area).otherwise(0.0),
    })
    return out.withColumn("total", F.col("infer") + F.col("postprocess") + F.col("encode") + F.col("qc"))


def stage_remaining(stage: Column, fraction: Column, elapsed: Column, predicted: Column, write: float = 0.35) -> Column:
    """Seconds left of the stage that runs.  Of encoding only the first part, ``write`` of it, has ticks."""
    rest = lambda p: F.greatest(F.lit(0.0), p - elapsed)
    w = F.least(F.lit(1.0), (fraction - 0.1) / 0.4)
    seen = F.when(fraction > 0, F.greatest(F.lit(0.0), elapsed / F.when(fraction > 0, fraction).otherwise(1.0) - elapsed)).otherwise(0.0)
    mixed = lambda p: F.when(fraction < 0.1, rest(p)).otherwise(w * seen + (1 - w) * rest(p))
    first, tail = predicted * write, predicted * (1 - write)
    after = F.greatest(F.lit(0.0), tail - F.greatest(F.lit(0.0), elapsed - first))
    return F.when(stage != "encode", mixed(predicted)).when(fraction >= 1, after).otherwise(mixed(first) + tail)


def overall_fraction(stage: Column, fraction: Column, qc: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Progress of a clip over all stages, in the order of ``weights``; without qc the others fill the whole."""
    def at(qc: bool) -> Column:
        out = F.lit(None).cast("double")
        for k, base, weight in stage_bases(weights, qc):
            out = F.when(stage == k, base + weight * fraction).otherwise(out)
        return out

    return F.when(qc, at(True)).otherwise(at(False))


# Settings

# What each mode sets, and which fields a request may set.
MODES = {"instant": ({"max_side": "1000", "encoder": "ss_alpha_gif"}, False), "quick": ({}, False), "thorough": ({}, True)}
ALLOWED = (
    ("device", "enum", None, None, ("cuda", "cpu", "auto")), ("use_keyer", "enum", None, None, ("auto", "on", "off")),
    ("encoder", "enum", None, None, ("supersampled_gif", "ss_alpha_gif", "mov", "webp")), ("supersample", "enum", None, None, ("1", "2", "3", "4")),
    ("use_trimap", "bool", None, None, None), ("apply_despill", "bool", None, None, None), ("strip_bg_fringe", "bool", None, None, None), ("keep_main_subject", "bool", None, None, None), ("qc", "bool", None, None, None),
    ("min_box_frac", "range", 0.01, 0.9, None), ("scale", "range", 0.2, 1.0, None), ("max_side", "range_or_none_int", 256.0, 4096.0, None),
    ("alpha_threshold", "range_int", 0.0, 255.0, None), ("mc_median_half", "range_int", 0.0, 3.0, None),
)
#: Stages that suppose a flat backdrop.
FLAT_ONLY = ("apply_clears", "strip_bg_fringe", "use_trimap")


def settings(requests: DataFrame, device: str = "cpu") -> DataFrame:
    """(request columns, code, config, run_qc): modes and overrides merged, from (mode, overrides map<string,string> of JSON values).

    The code is of the first fault: an unknown mode, or an override that is unknown or breaks its
    rule; then config and run_qc are null.  The device "auto" becomes ``device``; config says
    whether the encoder was asked for by name.
    """
    rules = F.create_map(*(x for f, kind, low, high, choices in ALLOWED for x in (F.lit(f), F.struct(F.lit(kind).alias("kind"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), F.array(*map(F.lit, choices or ())).cast("array<string>").alias("choices")))))

    def fits(key: Column, value: Column) -> Column:
        r = rules[key]
        bare = F.regexp_replace(value, '^"|"$', "")
        text = value.startswith('"')
        number = F.when(value.rlike(r"^-?[0-9]+([.][0-9]+)?$"), value.cast("double"))
        within = F.coalesce(number.between(r["low"], r["high"]), F.lit(False))
        whole = value.rlike(r"^-?[0-9]+$")
        listed = F.array_contains(r["choices"], bare) & (text == ~r["choices"][0].rlike("^[0-9]"))
        kind = r["kind"]
        return F.coalesce(
            F.when(kind == "bool", value.isin("true", "false")).when(kind == "enum", listed).when(kind == "range", within).when(kind == "range_int", within & whole).when(kind == "range_or_none_int", (value == "null") | (within & whole)),
            F.lit(False),
        )

    given = F.coalesce("overrides", F.create_map().cast("map<string,string>"))
    preset = F.create_map(*(x for m, (fields, _) in MODES.items() for x in (F.lit(m), F.create_map(*(F.lit(v) for kv in fields.items() for v in kv)).cast("map<string,string>"))))
    quality = F.create_map(*(F.lit(x) for m, (_, qc) in MODES.items() for x in (m, qc)))
    known = F.col("mode").isin(*MODES)
    good = F.size(F.map_filter(given, lambda k, v: ~fits(k, v))) == 0
    code = F.when(~F.coalesce(known, F.lit(False)), "E_BAD_MODE").when(~good, "E_BAD_OVERRIDE")
    own = F.transform_values(F.map_filter(given, lambda k, v: k != "qc"), lambda k, v: F.regexp_replace(v, '^"|"$', ""))
    base = F.map_filter(F.coalesce(preset[F.col("mode")], F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    merged = F.map_concat(base, own)
    asked = F.coalesce(merged["device"], F.lit("auto"))
    fixed = F.create_map(F.lit("device"), F.when(asked == "auto", device).otherwise(asked), F.lit("encoder_explicit"), F.map_contains_key(own, F.lit("encoder")).cast("string"))
    config = F.map_concat(F.map_filter(merged, lambda k, v: k != "device"), fixed)
    return requests.withColumns({"code": code, "config": F.when(code.isNull(), config), "run_qc": F.when(code.isNull(), F.coalesce(given["qc"] == "true", quality[F.col("mode")]))})


def auto_disabled(flat: Column, config: Column) -> Column:
    """Names of the stages that are on in the config and suppose the flat backdrop that the clip is known not to have."""
    on = F.filter(F.array(*map(F.lit, FLAT_ONLY)), lambda n: F.coalesce(config[n] == "true", F.lit(False)))
    return F.when(~F.coalesce(flat, F.lit(True)), on).otherwise(F.array().cast("array<string>"))


def scale_of(scale: Column, max_side: Column, w: Column, h: Column) -> Column:
    """The scale that was set, else the one that brings the long side to ``max_side``; never above 1."""
    return F.when(scale != 1, scale).when(F.coalesce(max_side, F.lit(0)) != 0, F.least(F.lit(1.0), max_side / F.greatest(w, h))).otherwise(1.0)


def frame_size_code(w: Column, h: Column, allowed: Column, most: float = 50.0) -> Column:
    """E_TOO_LARGE for frames of over ``most`` megapixels that nobody allowed."""
    return F.when((w * h / 1e6 > most) & ~allowed, "E_TOO_LARGE")


def disk_code(free: Column, needed: Column, margin: float = 1.5) -> Column:
    return F.when(free < needed * margin, "E_DISK_SPACE")


def guarded(frames: DataFrame, most: int) -> DataFrame:
    """``frames``, or an error when it is read if a clip has more than ``most``; never a silent cut."""
    n = frames.groupBy("clip_id").agg(F.count("*").alias("_n"))
    checked = n.withColumn("_n", F.when(F.col("_n") > most, F.raise_error(F.format_string("clip of %d frames, at most %d", F.col("_n"), F.lit(most))).cast("long")).otherwise(F.col("_n"))).where("_n > 0")
    return frames.join(checked, "clip_id").drop("_n")


def interpolated(key: Column, own: Column, fallback: Column, params: Column) -> Column:
    """The text of a key in the language, else in the fallback, else the key, with {{name}} replaced by the parameters."""
    text = F.coalesce(own[key], fallback[key], key)
    return F.aggregate(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>"))), text, lambda t, p: F.replace(t, F.concat(F.lit("{{"), p["key"], F.lit("}}")), p["value"]))


def merged_snapshot(snapshot: DataFrame, state: DataFrame, carried: list[str]) -> DataFrame:
    """``snapshot`` by (job_id, clip_no) with what the client already had of ``carried``; clips that are gone are dropped."""
    return snapshot.join(state.select("job_id", "clip_no", *carried), ["job_id", "clip_no"], "left")
