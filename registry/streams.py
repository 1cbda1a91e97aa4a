"""Streaming operators, each replaying a given table as a file stream; the SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.plans.library_views import stream_view
from mediashelf.session import shared_dir
from mediashelf.streaming import streams as st

from . import query
from .ingest import BACKLOG
from .people import STATS, refreshed


def replayed(t, spark, name):
    """The library table `name` as a stream over the same folder that t reads."""
    return stream_view(spark, t.sf_dir, name)


def place(spark, what):
    return shared_dir(spark, what), shared_dir(spark, f"{what}-checkpoint")


@query(
    "stream_dedup_uploads",
    "select distinct user_id, file_hash from uploads u where not exists (select 1 from files f where f.user_id = u.user_id and f.file_hash = u.file_hash and f.status <> 'failed')",
    ("uploads", "files"),
)
def _(t, spark):
    path, checkpoint = place(spark, "uploads")
    stream = replayed(t, spark, "uploads").select("user_id", "file_hash", "upload_id", "ts")
    st.ingest_uploads(stream, lambda: t("files"), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("user_id", "file_hash")


FIRST = """t as (select user_id, flow_id, min(case when state = 'completed' and stage = 'upload' then epoch_us(ts) end) as up, min(case when state = 'completed' and stage in ('embed', 'docindex') then epoch_us(ts) end) as work,
    min(case when state = 'failed' and stage not in ('faces', 'cancel') then epoch_us(ts) end) as fail, min(case when stage = 'cancel' then epoch_us(ts) end) as cancel from ev group by all),
  e as (select *, least(coalesce(case when up is not null and work is not null then greatest(up, work) end, 4611686018427387904), coalesce(fail, 4611686018427387904), coalesce(cancel, 4611686018427387904)) as fin from t),
  d as (select *, case when fin = 4611686018427387904 then null when fin = cancel then 'cancelled' when fin = fail then 'failed' else 'ready' end as ended from e),
  oc as (select user_id, flow_id, ended as outcome, fin as at_us from d where ended is not null union all select user_id, flow_id, 'stored', up from d where ended = 'failed' and up > fail and (cancel is null or up < cancel)
    union all select user_id, flow_id, 'cancelled', cancel from d where ended = 'failed' and cancel is not null)"""
NEWEST = ", ".join(f"first(props order by ts desc, event_id desc) filter (where stage = '{stage}' and state = 'completed') as {name}" for stage, name in st.OUTPUTS.items())
CONTROLLED = "ev as (select user_id, flow_id, ts, case when event_id % 40 = 7 then 'cancel' else stage end as stage, state from stage_events)"


def outcomes(t, spark, cancels=False):
    events = replayed(t, spark, "stage_events")
    if cancels:
        events = events.withColumn("stage", F.when(F.col("event_id") % 40 == 7, "cancel").otherwise(F.col("stage")))
    path, checkpoint = place(spark, "flows")
    st.finalize_stream(events, path, checkpoint).awaitTermination()
    return st.current_outcomes(spark, path)


@query(
    "stream_finalize",
    f"""with ev as (select * from stage_events), {FIRST}, pr as (select user_id, flow_id, {NEWEST} from ev group by all)
    select oc.user_id, oc.flow_id, outcome, at_us, case when outcome = 'ready' then embedded end as embedded, case when outcome = 'ready' then document end as document, case when outcome = 'ready' then faces end as faces
    from oc join pr using (user_id, flow_id) where outcome in ('ready', 'failed')""",
    ("stage_events",),
)
def _(t, spark):
    return outcomes(t, spark).filter("outcome in ('ready', 'failed')")


@query("stream_late_siblings", f"with ev as (select * from stage_events), {FIRST} select user_id, flow_id, at_us from oc where outcome = 'stored'", ("stage_events",))
def _(t, spark):
    return outcomes(t, spark).filter("outcome = 'stored'").select("user_id", "flow_id", "at_us")


@query("stream_cancel", f"with {CONTROLLED}, {FIRST} select user_id, flow_id, outcome, at_us from oc", ("stage_events",))
def _(t, spark):
    return outcomes(t, spark, cancels=True).filter("outcome <> 'settled'").select("user_id", "flow_id", "outcome", "at_us")


# the stages of every upload: (stage, state, seconds after the upload)
STAGES = """[{'stage': 'upload', 'state': case when upload_id % 17 = 0 then 'failed' else 'completed' end, 's': 60}, {'stage': 'embed', 'state': case when upload_id % 11 = 5 then 'failed' else 'completed' end, 's': 120},
    {'stage': case when upload_id % 6 = 1 then 'cancel' else 'faces' end, 'state': 'active', 's': 30 + cast(upload_id % 4 as int) * 60}]"""


@query(
    "stream_cancel_undo",
    f"""with x as (select user_id, concat(user_id, '_', file_hash) as flow_id, file_hash, upload_id, ts, unnest({STAGES}) as j from uploads), ev as (select user_id, flow_id, ts + to_seconds(j.s) as ts, j.stage, j.state from x), {FIRST},
    undone as (select distinct f.user_id, f.file_hash, f.file_id, f.provider_id, f.folder from files f join oc on oc.user_id = f.user_id and oc.flow_id = concat(f.user_id, '_', f.file_hash) where outcome = 'cancelled'),
    left_files as (select * from files f where not exists (select 1 from undone g where g.user_id = f.user_id and g.file_hash = f.file_hash)),
    nf as (select * from faces f where not exists (select 1 from undone g where g.user_id = f.user_id and g.file_id = f.file_id)),
    lost as (select distinct f.user_id, f.person_id from faces f join undone g on g.user_id = f.user_id and g.file_id = f.file_id), {STATS},
    n2 as (select rp.*, (select count(*) from nf where nf.user_id = rp.user_id and nf.person_id = rp.person_id) as n from rp),
    paths as (select distinct user_id, provider_id, array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') as path from (select *, unnest(range(1, len(string_split(folder, '/')) + 1)) as i from undone where folder <> '') y)
    select 'file' as kind, user_id, cast(file_id as varchar) as id, cast(0 as bigint) as n from left_files
    union all select 'face', user_id, cast(face_id as varchar), 0 from nf
    union all select 'person', user_id, cast(person_id as varchar), n from n2 where not (n = 0 and name is null and exists (select 1 from lost l where l.user_id = n2.user_id and l.person_id = n2.person_id))
    union all select 'passages', user_id, file_hash, count(*) from (select user_id, file_hash from files where media_type = 'document') u where not exists (select 1 from undone g where g.user_id = u.user_id and g.file_hash = u.file_hash) group by user_id, file_hash
    union all select 'folder', user_id, concat(provider_id, ':', path), 0 from paths p where not exists (select 1 from left_files f where f.user_id = p.user_id and f.provider_id = p.provider_id and (f.folder = p.path or starts_with(f.folder, p.path || '/')))""",
    ("uploads", "files", "faces", "people"),
)
def _(t, spark):
    """Every upload is a flow, one in six is cancelled; what is left of the library when the unfinished ones are undone."""
    stages = F.array(
        *(
            F.struct(F.lit(stage).alias("stage") if isinstance(stage, str) else stage.alias("stage"), F.expr(state).alias("state"), F.expr(s).cast("int").alias("s"))
            for stage, state, s in (
                ("upload", "if(upload_id % 17 = 0, 'failed', 'completed')", "60"),
                ("embed", "if(upload_id % 11 = 5, 'failed', 'completed')", "120"),
                (F.expr("if(upload_id % 6 = 1, 'cancel', 'faces')"), "'active'", "30 + upload_id % 4 * 60"),
            )
        )
    )
    flow = F.concat_ws("_", "user_id", "file_hash").alias("flow_id")
    events = replayed(t, spark, "uploads").select("user_id", flow, F.col("upload_id").alias("event_id"), "ts", F.inline(stages))
    events = events.withColumn("ts", F.timestamp_add("SECOND", F.col("s"), F.col("ts")))
    path, checkpoint = place(spark, "flows")
    st.finalize_stream(events, path, checkpoint).awaitTermination()
    files = t("files")
    passages = files.where("media_type = 'document'").select("user_id", "file_hash", F.lit(0).alias("chunk"))
    lib = {"files": files, "faces": t("faces"), "people": refreshed(t), "passages": passages}
    flows = files.select("user_id", flow, "file_hash", "provider_id", "folder")
    out, folders = st.undo_cancelled(lib, flows, st.current_outcomes(spark, path))

    def rows(df, kind, name, n=F.lit(0)):
        return df.select(F.lit(kind).alias("kind"), "user_id", name.cast("string").alias("id"), n.cast("long").alias("n"))

    return (
        rows(out["files"], "file", F.col("file_id"))
        .unionByName(rows(out["faces"], "face", F.col("face_id")))
        .unionByName(rows(out["people"], "person", F.col("person_id"), F.col("face_count")))
        .unionByName(rows(out["passages"].groupBy("user_id", "file_hash").count(), "passages", F.col("file_hash"), F.col("count")))
        .unionByName(rows(folders, "folder", F.concat_ws(":", "provider_id", "path")))
    )


@query(
    "stream_rate",
    """with w as (select user_id, time_bucket(interval 1 minute, ts) as window_start, count(*) as n_requests from events group by all)
    select user_id, window_start, n_requests, n_requests > 1 as over_limit from w where window_start + interval 1 minute <= (select max(ts) - interval 1 minute from events)""",
)
def _(t, spark):
    events = replayed(t, spark, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return st.run_to_table(st.rates(events, 1))


@query("stream_backlog", f"with {BACKLOG} select stage, cast(jobs as bigint) as jobs from bl union all select 'total', cast(sum(jobs) as bigint) from bl", ("stage_events",))
def _(t, spark):
    path, checkpoint = place(spark, "jobs")
    st.backlog_stream(replayed(t, spark, "stage_events"), path, checkpoint).awaitTermination()
    return st.current_backlog(spark, path)


@query("stream_upsert_sink", "select user_id, file_hash, upload_id from (select *, row_number() over (partition by user_id, file_hash order by ts desc, upload_id desc) as r from uploads) x where r = 1", ("uploads",))
def _(t, spark):
    path, checkpoint = place(spark, "log")
    stream = replayed(t, spark, "uploads").select("user_id", "file_hash", "upload_id", "ts")
    st.upsert_sink(stream, path, checkpoint).awaitTermination()
    rows = st.current_rows(spark, path, ["user_id", "file_hash"], [F.desc("ts"), F.desc("upload_id")])
    return rows.select("user_id", "file_hash", "upload_id")


@query("stream_faces")
def _(t, spark):
    path, checkpoint = place(spark, "faces")
    faces = replayed(t, spark, "faces").withColumn("file_seq", F.col("file_id") + 1)
    new = faces.filter("score >= 0.3 or score is null").drop("person_id")
    st.assign_faces_stream(new, lambda: t("faces").filter("score < 0.3"), path, checkpoint, 0.2).awaitTermination()
    return spark.read.parquet(path).select("user_id", "file_id", "face_id", "person_id")
