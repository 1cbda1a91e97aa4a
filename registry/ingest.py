"""The ingest pipeline: states, backlog, fair share, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.operators import ingest as ig

from . import query

LATEST = "lj as (select * from (select *, row_number() over (partition by user_id, flow_id, stage order by ts desc, event_id desc) as r from stage_events) x where r = 1)"
BACKLOG = f"""{LATEST}, bl as (select stage, count(case when state in ('waiting', 'prioritized', 'active', 'delayed') then 1 end) as jobs from lj group by stage)"""
EV = ("stage_events",)


@query("agg_backlog", f"with {BACKLOG} select stage, cast(jobs as bigint) as jobs from bl union all select 'total', cast(sum(jobs) as bigint) from bl", EV)
def _(t, spark):
    return ig.backlog(t("stage_events"))


@query(
    "agg_desired_replicas",
    f"""with {BACKLOG}, r as (select 'worker' as service, unnest(['upload', 'embed', 'faces', 'finalize']) as stage, 20 as target, 1 as low, 8 as high union all select 'ml', unnest(['embed', 'faces']), 10, 1, 3)
    select service, cast(sum(jobs) as bigint) as jobs, cast(least(max(high), greatest(max(low), ceil(sum(jobs) / greatest(1, max(target))))) as bigint) as replicas from bl join r using (stage) group by service""",
    EV,
)
def _(t, spark):
    return ig.capacity(ig.backlog(t("stage_events")))


@query(
    "agg_flow_status",
    f"""with {LATEST}, f as (select user_id, flow_id, max(case when stage = 'finalize' then state end) as fin, max(case when stage = 'finalize' then reason end) as fin_reason,
      max(case when stage = 'upload' then state end) as up, max(case when stage = 'upload' then reason end) as up_reason, coalesce(max(case when stage = 'upload' then attempt end), 0) as up_try,
      max(case when stage = 'embed' then state end) as emb, max(case when stage = 'embed' then reason end) as emb_reason, coalesce(max(case when stage = 'embed' then attempt end), 0) as emb_try from lj group by all),
    s as (select *, case when fin = 'completed' then 'done' when fin = 'failed' then 'failed' when fin in ('active', 'waiting', 'prioritized') then 'finalizing' when up = 'active' then 'uploading'
      when up in ('waiting', 'prioritized', 'delayed', 'waiting-children') then 'queued' else 'indexing' end as stage from f)
    select user_id, flow_id, case stage when 'done' then 'completed' when 'failed' then 'failed' else 'active' end as state, stage,
      case when stage = 'failed' then coalesce(case when up = 'failed' then up_reason end, case when emb = 'failed' then emb_reason end, fin_reason, 'Processing failed') end as error,
      coalesce(fin, '') not in ('completed', 'failed') and up_try + emb_try > 0 and coalesce(up, '') not in ('waiting', 'prioritized', 'delayed', 'waiting-children') as retrying from s""",
    EV,
)
def _(t, spark):
    return ig.flow_status(t("stage_events"))


PENDING = """c as (select *, case when delta < 0 and coalesce(lag(delta) over (partition by user_id, flow_id order by ts, event_id) < 0, false) then 0 else delta end as d from queue_events),
  s as (select *, sum(d) over (partition by user_id order by ts, event_id rows unbounded preceding) as total from c),
  p as (select *, cast(total - least(0, min(total) over (partition by user_id order by ts, event_id rows unbounded preceding)) as bigint) as pending from s)"""


@query("win_running_pending", f"with {PENDING} select event_id, user_id, pending from p", ("queue_events",))
def _(t, spark):
    return ig.pending(t("queue_events")).select("event_id", "user_id", "pending")


@query("win_fair_share", f"with {PENDING} select event_id, user_id, cast(least(2097151, greatest(1, pending)) as bigint) as priority from p where d > 0", ("queue_events",))
def _(t, spark):
    return ig.fair_share(t("queue_events")).select("event_id", "user_id", "priority")


# ---------------------------------------------------------------- repair
def file_flows(t):
    """State of the newest flow of each file: derived from the file's own facts."""
    return t("files").selectExpr("user_id", "file_hash", "case provider_id when 1 then 'active' when 2 then 'waiting' when 4 then 'failed' else 'completed' end as state")


FILE_FLOWS = "fl as (select user_id, file_hash, case provider_id when 1 then 'active' when 2 then 'waiting' when 4 then 'failed' else 'completed' end as state from files)"


@query(
    "anti_retry_deletes",
    f"""with {FILE_FLOWS}, live as (select * from files where status = 'ready' and kind in ('photo', 'meme', 'chart'))
    select distinct user_id, file_hash from uploads u where not exists (select 1 from live f where f.user_id = u.user_id and f.file_hash = u.file_hash)
      and not exists (select 1 from fl where fl.user_id = u.user_id and fl.file_hash = u.file_hash and fl.state not in ('failed', 'missing', 'completed'))""",
    ("uploads", "files"),
)
def _(t, spark):
    pending = t("uploads").select("user_id", "file_hash")
    stored = t("files").filter("status = 'ready' and kind in ('photo', 'meme', 'chart')")
    return ig.deletes_to_run(pending, stored, file_flows(t))


@query(
    "anti_orphan_staged",
    """with st as (select concat('f', event_id) as name, ts as modified_at from events),
    jb as (select concat('f', event_id) as name, state from stage_events)
    select st.name from st where modified_at < timestamp '2024-01-25 00:00:00' - interval 1 day and not exists (select 1 from jb where jb.name = st.name and jb.state in ('waiting', 'prioritized', 'active', 'delayed', 'waiting-children'))""",
    EV,
)
def _(t, spark):
    staged = t("events").selectExpr("concat('f', event_id) as name", "cast(ts as timestamp) as modified_at")
    jobs = t("stage_events").selectExpr("concat('/data/uploads/f', event_id) as tmp_path", "state")
    return ig.orphans(staged, jobs, F.lit("2024-01-25 00:00:00").cast("timestamp")).select("name")


@query(
    "anti_empty_folders",
    """with del as (select * from files where folder <> '' and kind in ('receipt', 'chart', 'meme')), rest as (select * from files where kind in ('photo', 'document') and camera = 'Pixel 8' and faces_scanned),
    fly as (select * from files where kind = 'screenshot' and status = 'indexing' and folder <> ''),
    anc as (select distinct user_id, provider_id, array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') as path from (select *, unnest(range(1, len(string_split(folder, '/')) + 1)) as i from del) x)
    select user_id, provider_id, path, cast(len(string_split(path, '/')) as int) as depth from anc a where not exists (select 1 from (select * from rest union all select * from fly) r where r.user_id = a.user_id and r.provider_id = a.provider_id and (r.folder = a.path or starts_with(r.folder, a.path || '/')))""",
    ("files",),
)
def _(t, spark):
    f = t("files")
    gone = f.filter("kind in ('receipt', 'chart', 'meme')")
    rest = f.filter("kind in ('photo', 'document') and camera = 'Pixel 8' and faces_scanned")
    return ig.removable_folders(gone, rest, f.filter("kind = 'screenshot' and status = 'indexing'"))


@query(
    "sort_folders_deepest",
    """select distinct user_id, provider_id, array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') as path, cast(i as int) as depth
    from (select *, unnest(range(1, len(string_split(folder, '/')) + 1)) as i from files where folder <> '') x""",
    ("files",),
)
def _(t, spark):
    """Deletion order: children before parents, by a range-partitioned sort."""
    none = t("files").filter("folder is null")
    return ig.removable_folders(t("files"), none).orderBy(F.desc("depth"), "user_id", "path")


@query(
    "finalize_files",
    """with st as (select file_id, user_id, file_hash, 'upload' as stage, case when file_id % 9 = 0 then 'active' else 'completed' end as state from files
      union all select file_id, user_id, file_hash, 'embed', case when kind = 'meme' then 'failed' else 'completed' end from files union all select file_id, user_id, file_hash, 'docindex', case when kind = 'chart' then 'failed' else 'completed' end from files),
    ok as (select file_id, max(case when stage = 'upload' and state = 'completed' then 1 else 0 end) as u, max(case when stage = 'embed' and state = 'completed' then 1 else 0 end) as e, max(case when stage = 'docindex' and state = 'completed' then 1 else 0 end) as d from st group by file_id)
    select f.file_id, 'ready' as status, case when media_type = 'document' then 'document' else concat('new ', kind) end as kind, case when media_type = 'document' then coalesce('Doc ' || f.place_city, f.name) else title end as title,
      case when media_type = 'document' then cast(3 as int) else page_count end as page_count, case when media_type = 'document' then embed_model else 'm9' end as embed_model
    from files f join ok using (file_id) where u = 1 and case when media_type = 'document' then d else e end = 1""",
    ("files",),
)
def _(t, spark):
    f = t("files")
    key = ["user_id", "file_hash"]

    def stage(name, state):
        return f.select(*key, F.lit(name).alias("stage"), F.expr(state).alias("state"))

    stages = (
        stage("upload", "if(file_id % 9 = 0, 'active', 'completed')")
        .unionByName(stage("embed", "if(kind = 'meme', 'failed', 'completed')"))
        .unionByName(stage("docindex", "if(kind = 'chart', 'failed', 'completed')"))
    )
    embedded = f.select(*key, F.concat(F.lit("new "), "kind").alias("kind"), F.lit("m9").alias("embed_model"))
    documents = f.select(*key, F.concat(F.lit("Doc "), "place_city").alias("title"), F.lit(3).alias("page_count"), F.lit("x").alias("excerpt"))
    return ig.finalize(f, stages, embedded, documents).select("file_id", "status", "kind", "title", "page_count", "embed_model")


@query(
    "stream_settle_stuck",
    f"""with {FILE_FLOWS} select file_id, case when status = 'indexing' and provider_file_id is not null and created_at < timestamp '2024-09-01 00:00:00' - interval 30 minute and coalesce(fl.state, 'missing') in ('failed', 'missing', 'completed') then 'ready' else status end as status
    from files f left join fl on fl.user_id = f.user_id and fl.file_hash = f.file_hash and fl.state <> 'failed'""",
    ("files",),
)
def _(t, spark):
    known = file_flows(t).filter("state <> 'failed'")  # forgotten flows count as missing
    return ig.settle_stuck(t("files"), known, F.lit("2024-09-01 00:00:00").cast("timestamp")).select("file_id", "status")
