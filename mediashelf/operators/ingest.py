"""The ingest pipeline as tables of events: dedup, states, backlog, fair share, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..session import cut_lineage
from .library import folder_ancestors

STAGES = ("upload", "embed", "faces", "docindex", "finalize")
QUEUED = ("waiting", "prioritized", "delayed", "waiting-children")
BACKLOG_STATES = ("waiting", "prioritized", "active", "delayed")
OVER = ("failed", "missing", "completed")


# ---------------------------------------------------------------- uploads
def once_per_flow(uploads: DataFrame) -> DataFrame:
    """The same content sent twice by one user is one flow; the first upload stands for all.

    A minimum over the row combines before the shuffle, so exact copies never gather anywhere.
    """
    rest = [c for c in uploads.columns if c not in ("user_id", "file_hash", "upload_id")]
    row = F.struct("upload_id", *rest)
    first = uploads.groupBy("user_id", "file_hash").agg(F.min_by(row, "upload_id").alias("r"))
    return first.select("user_id", "file_hash", "r.*")


def new_uploads(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Uploads whose content the user does not have yet; a failed earlier try may be repeated.

    Catalyst adds a Bloom filter of the stored keys to the upload side when that pays.
    """
    stored = files.filter("status <> 'failed'").select("user_id", "file_hash")
    return uploads.join(stored, ["user_id", "file_hash"], "left_anti")


def unlisted(uploads: DataFrame, listed: DataFrame) -> DataFrame:
    """Uploads not already in the client's list (same folder, name and size, and not in error)."""
    keys = ["user_id", "folder", "name", "size"]
    return uploads.join(listed.filter("status <> 'error'").select(*keys), keys, "left_anti")


def cloud_names(uploads: DataFrame) -> DataFrame:
    """Adds cloud_name: the cleaned name (or hash + extension); a taken name gets ' (hash8)' before its extension.

    The first upload of a name in a folder keeps it. First means lowest upload_id, found by a combining
    minimum and joined back, so a name used by a third of all files is no hot group.
    """
    ext = F.substring(tx.extension(F.col("name")), 1, 10)
    clean = F.coalesce(F.nullif(tx.clean_name(F.col("name")), F.lit("")), F.concat("file_hash", ext))
    named = uploads.withColumn("_clean", clean)
    keys = ["user_id", "folder", "_clean"]
    owner = named.groupBy(*keys).agg(F.min("upload_id").alias("_first"))
    base = F.regexp_replace("_clean", r"^(.+)\.[^.]*$", "$1")
    suffix = F.regexp_extract("_clean", r"^.+(\.[^.]*)$", 1)
    tagged = F.concat(base, F.lit(" ("), F.substring("file_hash", 1, 8), F.lit(")"), suffix)
    return (
        named.join(owner, keys)
        .withColumn("cloud_name", F.when(F.col("upload_id") == F.col("_first"), F.col("_clean")).otherwise(tagged))
        .drop("_clean", "_first")
    )


# ---------------------------------------------------------------- running counters
def in_ranges(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """Adds _block: which of the ranges of `order`, cut by sampled ranks, a row falls into; ranges are numbered in that order."""
    cuts = [F.col(c).asc() for c in order]
    return (df.repartitionByRange(blocks, *cuts) if blocks else df.repartitionByRange(*cuts)).withColumn("_block", F.spark_partition_id())


def running_low(df: DataFrame, by: str, value: str, ts: str = "ts", tie: str = "event_id", blocks: int | None = None) -> DataFrame:
    """Adds total (running sum of `value` per key in time order) and low (lowest total so far).

    Rows are cut into ranges of (key, time, tie) by sampled ranks, about as many rows in each, and prefix sums are taken inside a range and then over
    the totals of a key's ranges. So a key is as many tasks as it has ranges, also if all its rows fall into one hour or bear one time. The rows are
    written once with their range, for a range must not change between the two levels. `blocks`: how many ranges, else as many as a shuffle has partitions.
    """
    ranged = in_ranges(df, [by, ts, tie], blocks)
    inside = W.partitionBy(by, "_block").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut_lineage(ranged.withColumn("_sum", F.sum(value).over(inside)).withColumn("_low", F.min("_sum").over(inside)))
    parts = local.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_at")).agg(F.sum(value).alias("_total"), F.min("_low").alias("_dip"))
    before = W.partitionBy("_by").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    parts = parts.withColumn("_past_low", F.min(F.col("_offset") + F.col("_dip")).over(before)).drop("_total", "_dip")
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_at"))
    return (
        local.join(parts, same)
        .withColumn("total", F.col("_sum") + F.col("_offset"))
        .withColumn("low", F.least(F.col("_low") + F.col("_offset"), "_past_low"))
        .drop("_by", "_at", "_block", "_sum", "_low", "_offset", "_past_low")
    )


def pending(queue_events: DataFrame) -> DataFrame:
    """Adds pending: the user's queued files after each event, never below zero, one release per flow.

    A counter that is reset to zero whenever it would go negative equals total - min(0, lowest total so far), so
    the path-dependent floor needs no sequential code.
    """
    flow = W.partitionBy("user_id", "flow_id").orderBy("ts", "event_id")
    repeat = (F.col("delta") < 0) & F.coalesce(F.lag("delta").over(flow) < 0, F.lit(False))
    counted = queue_events.withColumn("delta", F.when(repeat, 0).otherwise(F.col("delta")).cast("long"))
    return (
        running_low(counted, "user_id", "delta")
        .withColumn("pending", F.col("total") - F.least(F.lit(0), F.col("low")))
        .drop("total", "low")
    )


def fair_share(queue_events: DataFrame) -> DataFrame:
    """Queue priority of each enqueue: how many files its user then has queued, so that users interleave."""
    clamped = F.least(F.lit(fv.MAX_PRIORITY), F.greatest(F.lit(1), F.col("pending")))
    return pending(queue_events).filter("delta > 0").withColumn("priority", clamped.cast("long")).drop("delta")


# ---------------------------------------------------------------- states
def latest_states(stage_events: DataFrame) -> DataFrame:
    """Newest event per job (flow and stage), by a combining maximum."""
    row = F.struct("ts", "event_id", "state", "attempt", "reason")
    return (
        stage_events.groupBy("user_id", "flow_id", "stage")
        .agg(F.max(row).alias("r"))
        .select("user_id", "flow_id", "stage", "r.*")
    )


def backlog(stage_events: DataFrame) -> DataFrame:
    """Jobs waiting or running per stage, and their total."""
    live = latest_states(stage_events).groupBy("stage").agg(
        F.count(F.when(F.col("state").isin(*BACKLOG_STATES), 1)).alias("jobs")
    )
    return live.rollup("stage").agg(F.sum("jobs").alias("jobs")).withColumn("stage", F.coalesce("stage", F.lit("total")))


def desired_replicas(n: Column, target: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, F.ceil(n / F.greatest(F.lit(1), target)))).cast("long")


def capacity(per_stage: DataFrame, rules=fv.SCALING_RULES) -> DataFrame:
    """Replicas each service should run, from the backlog of the stages it serves."""
    rows = [
        F.struct(
            F.lit(service).alias("service"), F.lit(stage).alias("_stage"), F.lit(target).alias("target"),
            F.lit(low).alias("low"), F.lit(high).alias("high"),
        )
        for service, stages, target, low, high in rules
        for stage in stages
    ]
    served = per_stage.select("stage", "jobs", F.inline(F.array(*rows))).filter("stage = _stage")
    return (
        served.groupBy("service", "target", "low", "high")
        .agg(F.sum("jobs").alias("jobs"))
        .select(
            "service",
            "jobs",
            desired_replicas(F.col("jobs"), F.col("target"), F.col("low"), F.col("high")).alias("replicas"),
        )
    )


def flow_status(stage_events: DataFrame) -> DataFrame:
    """One row per flow: state, stage shown to the user, error and retrying.

    One aggregation: the newest event of each stage is a conditional maximum. A flow without a finalize event
    waits for its children.
    """
    row = F.struct("ts", "event_id", "state", "attempt", "reason")
    flows = stage_events.groupBy("user_id", "flow_id").agg(
        *[F.max(F.when(F.col("stage") == s, row)).alias(s) for s in ("upload", "embed", "finalize")]
    )
    fin, up, emb = (F.coalesce(F.col(f"{s}.state"), F.lit("missing")) for s in ("finalize", "upload", "embed"))
    stage = (
        F.when(fin == "completed", "done")
        .when(fin == "failed", "failed")
        .when(fin.isin("active", "waiting", "prioritized"), "finalizing")
        .when(up == "active", "uploading")
        .when(up.isin(*QUEUED), "queued")
        .otherwise("indexing")
    )
    reason = F.coalesce(
        F.when(up == "failed", F.col("upload.reason")),
        F.when(emb == "failed", F.col("embed.reason")),
        F.col("finalize.reason"),
        F.lit("Processing failed"),
    )
    tries = F.coalesce("upload.attempt", F.lit(0)) + F.coalesce("embed.attempt", F.lit(0))
    return flows.select(
        "user_id",
        "flow_id",
        F.when(stage == "done", "completed").when(stage == "failed", "failed").otherwise("active").alias("state"),
        stage.alias("stage"),
        F.when(stage == "failed", reason).alias("error"),
        (~fin.isin("completed", "failed") & (tries > 0) & ~up.isin(*QUEUED)).alias("retrying"),
    )


# ---------------------------------------------------------------- repair
def deletes_to_run(pending_deletes: DataFrame, files: DataFrame, flows: DataFrame) -> DataFrame:
    """Retry an index delete unless the same content is stored again or on its way."""
    keys = ["user_id", "file_hash"]
    live = flows.filter(~F.col("state").isin(*OVER)).select(*keys)
    return pending_deletes.distinct().join(files.select(*keys), keys, "left_anti").join(live, keys, "left_anti")


def orphans(staged: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Staged files older than a day that no live job refers to."""
    needed = jobs.filter(F.col("state").isin(*QUEUED, "active")).select(
        F.element_at(F.split("tmp_path", "/"), -1).alias("name")
    )
    return staged.filter(F.col("modified_at") < now - F.expr("interval 1 day")).join(needed, "name", "left_anti")


def removable_folders(
    deleted: DataFrame, remaining: DataFrame, inflight: DataFrame | None = None, depth: int = 1
) -> DataFrame:
    """Folders of deleted files (from `depth` down) with no file and no running upload at or below them.

    A folder is in use exactly when it is among the ancestors of a remaining file, so the test is an anti-join.
    The caller removes them deepest first (`depth` descending).
    """
    candidates = folder_ancestors(deleted, depth).distinct()
    used = folder_ancestors(remaining)
    if inflight is not None:
        used = used.unionByName(folder_ancestors(inflight))
    free = candidates.join(used, candidates.columns, "left_anti")
    return free.withColumn("depth", F.size(F.split("path", "/")))


def settle_stuck(files: DataFrame, flows: DataFrame, now: Column) -> DataFrame:
    """Files 'indexing' for over 30 minutes whose flow is over (or unknown) are shown as ready."""
    stuck = (
        (F.col("status") == "indexing")
        & F.col("provider_file_id").isNotNull()
        & (F.col("created_at") < now - F.expr("interval 30 minutes"))
    )
    state = flows.select("user_id", "file_hash", F.col("state").alias("_flow"))
    over = F.coalesce("_flow", F.lit("missing")).isin(*OVER)
    return (
        files.join(state, ["user_id", "file_hash"], "left")
        .withColumn("status", F.when(stuck & over, "ready").otherwise(F.col("status")))
        .drop("_flow")
    )


def finalize(files: DataFrame, stages: DataFrame, embedded: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the flows whose required stages completed, with the facts those stages produced.

    `stages`: user_id, file_hash, stage, state (newest per job). Images need upload and embed, documents upload
    and docindex; faces are optional. `embedded` brings the image columns, `documents` title, page_count, excerpt.
    """
    keys = ["user_id", "file_hash"]
    done = stages.groupBy(*keys).agg(
        *[
            F.max((F.col("stage") == s) & (F.col("state") == "completed")).alias(f"_{s}")
            for s in ("upload", "embed", "docindex")
        ]
    )
    is_doc = F.col("media_type") == "document"
    ready = files.join(done, keys).filter(F.col("_upload") & F.when(is_doc, F.col("_docindex")).otherwise(F.col("_embed")))
    facts = [c for c in embedded.columns if c not in keys]
    e = embedded.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in facts])
    d = documents.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in ("title", "page_count", "excerpt")])

    def value(c: str) -> Column:
        if c == "status":
            return F.lit("ready").alias(c)
        if c == "kind":
            return F.when(is_doc, "document").otherwise(F.col("_e_kind") if "kind" in facts else F.col(c)).alias(c)
        if c == "title":
            return F.when(is_doc, F.coalesce("_d_title", "name")).otherwise(F.col(c)).alias(c)
        if c in ("page_count", "excerpt"):
            return F.when(is_doc, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c)
        if c in facts:
            return F.when(is_doc, F.col(c)).otherwise(F.col(f"_e_{c}")).alias(c)
        return F.col(c)

    return ready.join(e, keys, "left").join(d, keys, "left").select(*[value(c) for c in files.columns])


def cancellations(flows: DataFrame, cancels: DataFrame) -> DataFrame:
    """Outcome of each cancel: 'done' (already finished), 'missing' (unknown flow) or 'cancelled' (undo it)."""
    state = flows.select("user_id", "flow_id", F.col("state").alias("_state"))
    outcome = (
        F.when(F.col("_state").isNull(), "missing").when(F.col("_state") == "completed", "done").otherwise("cancelled")
    )
    return cancels.join(state, ["user_id", "flow_id"], "left").withColumn("outcome", outcome).drop("_state")


def request_rate(requests: DataFrame, limit: int, width: str = "1 minute") -> DataFrame:
    """Requests per user and tumbling window, with the limit's verdict. Works on batches and streams."""
    return (
        requests.groupBy("user_id", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n_requests"))
        .select("user_id", F.col("w.start").alias("window_start"), "n_requests", (F.col("n_requests") > limit).alias("over_limit"))
    )
