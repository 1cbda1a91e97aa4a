"""Structured Streaming forms of the ingest operators.

Each function takes a streaming DataFrame; those ending in a sink return the started StreamingQuery. State is keyed by
job, or is a log of combining aggregates by flow, so it spreads over the cluster; sinks write one directory per micro-batch, which makes replays harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.faces import assign_faces
from ..operators.ingest import backlog, new_uploads, removable_folders, request_rate
from ..operators.people import delete_files
from ..session import shared_dir
from ..sources.sinks import latest

def _start(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Process what is there and stop, or keep going with a trigger such as {"processingTime": "10 seconds"}."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()


# ---------------------------------------------------------------- keyed log sink
def append_changes(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch of a keyed table. A replayed batch overwrites its own directory."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keyed upsert of a stream: cost follows the batch, not the table. Read with `current_rows`."""
    return _start(stream, checkpoint, lambda df, i: append_changes(df, i, path), trigger=trigger)


def current_rows(spark: SparkSession, path: str, keys: list[str], order: list) -> DataFrame:
    """The table a keyed log stands for: the newest row of each key; equal rows go to the later batch."""
    return latest(spark.read.parquet(path), keys, [*order, F.desc("batch_id")]).drop("batch_id")


def compact(spark: SparkSession, path: str, target: str, keys: list[str], order: list) -> None:
    """Write the current rows as batch 0 of a new log; switch readers and the sink to it afterwards."""
    current_rows(spark, path, keys, order).write.mode("errorifexists").parquet(f"{target}/batch_id=0")


# ---------------------------------------------------------------- uploads
def dedup_uploads(stream: DataFrame, delay: str) -> DataFrame:
    """At most one upload per (user, content) within the delay; the state of older ones is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "file_hash"])


def ingest_uploads(stream: DataFrame, read_files: Callable[[], DataFrame], path: str, checkpoint: str, delay: str = "7 days", trigger: dict | None = None) -> StreamingQuery:
    """Write the uploads that start a flow: not in flight and not stored. The stored files are read per batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        append_changes(new_uploads(batch, read_files()), batch_id, path)

    return _start(dedup_uploads(stream, delay), checkpoint, each, trigger=trigger)


def rates(stream: DataFrame, limit: int, delay: str = "1 minute") -> DataFrame:
    """Requests per user and minute with the limit's verdict; windows close when the watermark passes them."""
    return request_rate(stream.withWatermark("ts", delay), limit)


# ---------------------------------------------------------------- flows
FLOW = ["user_id", "flow_id"]
FAR = 1 << 62

#: What a flow's events come to, in microseconds: when its upload and its work were first done, when it first failed and was first cancelled.
MOMENTS = ("up", "work", "fail", "cancel")

#: Stages whose newest completed output makes the finalised row.
OUTPUTS = {"embed": "embedded", "docindex": "document", "faces": "faces"}


def flow_moments(stage_events: DataFrame) -> DataFrame:
    """One row per flow: its MOMENTS, when it was last heard of, and the newest completed output of each stage in OUTPUTS.

    Every column is a minimum or a maximum, so rows of parts of the events merge to those of all (`merged_moments`), in any order and however
    often a part is repeated. `stage_events`: user_id, flow_id, event_id, ts, stage, state and optionally props, the output.
    """
    us, ok = F.unix_micros("ts"), F.col("state") == "completed"

    def first(cond) -> F.Column:
        return F.min(F.when(cond, us))

    output = F.col("props") if "props" in stage_events.columns else F.lit(None).cast("string")
    newest = F.struct(us.alias("at_us"), F.col("event_id"), output.alias("output"))
    return stage_events.groupBy(*FLOW).agg(
        first(ok & (F.col("stage") == "upload")).alias("up"),
        first(ok & F.col("stage").isin("embed", "docindex")).alias("work"),
        first((F.col("state") == "failed") & ~F.col("stage").isin("faces", "cancel")).alias("fail"),
        first(F.col("stage") == "cancel").alias("cancel"),
        F.max(us).alias("heard"),
        *(F.max(F.when(ok & (F.col("stage") == stage), newest)).alias(name) for stage, name in OUTPUTS.items()),
    )


def merged_moments(parts: DataFrame) -> DataFrame:
    """The moments of each flow from those of any parts of its events."""
    return parts.groupBy(*FLOW).agg(*(F.min(m).alias(m) for m in MOMENTS), *(F.max(c).alias(c) for c in ("heard", *OUTPUTS.values())))


def outcomes(moments: DataFrame, now_us: int | None = None, stuck_us: int = 30 * 60_000_000) -> DataFrame:
    """(user_id, flow_id, outcome, at_us and the outputs): how flows ended, by the time of their events.

    'ready' once upload and embed (or docindex) are completed, 'failed' at the first failure of a stage other than faces, 'cancelled' at a
    cancel, whichever comes first. A failed flow is 'stored' too if its upload completes later and before a cancel (kept and shown, not
    searchable), and 'cancelled' too if a cancel follows: only a ready flow can't be undone. With `now_us`, an upload still undecided `stuck_us`
    after it was stored is 'settled'. Only ready flows have outputs.
    """
    far = F.lit(FAR)
    t = moments.withColumn("done", F.when(F.col("up").isNotNull() & F.col("work").isNotNull(), F.greatest("up", "work")))
    t = t.withColumn("end", F.least(*[F.coalesce(c, far) for c in ("done", "fail", "cancel")]))
    ended = F.when(F.col("end") == F.col("cancel"), "cancelled").when(F.col("end") == F.col("fail"), "failed").otherwise("ready")
    t = t.withColumn("ended", F.when(F.col("end") < far, ended))
    failed, stuck = F.col("ended") == "failed", F.col("up") + stuck_us

    def row(cond, name, at) -> F.Column:
        return F.when(cond, F.struct(name.alias("outcome"), at.alias("at_us")))

    rows = [
        row(F.col("ended").isNotNull(), F.col("ended"), F.col("end")),
        row(failed & (F.col("up") > F.col("fail")) & (F.col("up") < F.coalesce("cancel", far)), F.lit("stored"), F.col("up")),
        row(failed & F.col("cancel").isNotNull(), F.lit("cancelled"), F.col("cancel")),
    ]
    if now_us is not None:
        rows.append(row(F.col("ended").isNull() & (stuck <= now_us), F.lit("settled"), stuck))
    outputs = [F.when(F.col("ended") == "ready", F.col(c)["output"]).alias(c) for c in OUTPUTS.values()]
    wide = t.select(*FLOW, *outputs, F.inline(F.array_compact(F.array(*rows))))
    ready = F.col("outcome") == "ready"
    return wide.select(*FLOW, "outcome", "at_us", *(F.when(ready, F.col(c)).alias(c) for c in OUTPUTS.values()))


def flow_outcomes(stage_events: DataFrame) -> DataFrame:
    """The outcomes of a finished table of events."""
    return outcomes(flow_moments(stage_events))


def finalize_stream(stage_events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write every micro-batch's moments of its flows to a log; `current_outcomes` reads what they come to.

    The log is the state: a batch costs its own events, whatever came before, late events need no limit, and a replayed batch overwrites
    itself. Events of stage 'cancel' cancel their flow. `fold_flows` keeps the log short.
    """
    return _start(stage_events, checkpoint, lambda df, i: append_changes(flow_moments(df), i, path), trigger=trigger)


def current_outcomes(spark: SparkSession, path: str, delay_us: int = 10 * 60_000_000, stuck_us: int = 30 * 60_000_000) -> DataFrame:
    """The outcomes of all flows in a log. The clock is the newest event's time less `delay_us`; by it undecided uploads are settled."""
    log = spark.read.parquet(path)
    newest = log.agg(F.max("heard").alias("t")).head().t
    return outcomes(merged_moments(log), None if newest is None else newest - delay_us, stuck_us)


def fold_flows(spark: SparkSession, path: str, target: str, keep_us: int | None = None) -> None:
    """Write one row per flow as the first batch of a new log; switch readers and the sink to it afterwards.

    With `keep_us`, ready and cancelled flows last heard of more than that before the newest event are left out: nothing can follow for them. Take
    their outcomes over first.
    """
    log = spark.read.parquet(path)
    rows = merged_moments(log)
    if keep_us is not None and (newest := log.agg(F.max("heard").alias("t")).head().t) is not None:
        over = outcomes(rows).where("outcome in ('ready', 'cancelled')").select(*FLOW).distinct().withColumn("over", F.lit(True))
        rows = rows.join(over, FLOW, "left").where(F.col("over").isNull() | (F.col("heard") >= newest - keep_us)).drop("over")
    rows.write.mode("errorifexists").parquet(f"{target}/batch_id=-1")


def undo_cancelled(lib: dict[str, DataFrame], flows: DataFrame, ended: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The library without what cancelled flows brought, and the folders that go with it: (user_id, provider_id, path, depth).

    `lib`: files, faces, people and optionally image_index and passages. `flows` (user_id, flow_id, file_hash, provider_id, folder): what each flow
    carries. `ended`: outcomes. A cancel is a tombstone in the flows' log and is applied to whatever snapshot is read, so doing it again, also
    after a replay or to a compacted table, changes nothing. Vectors and passages go even where there is no row of the file. Content that another
    flow of the same user made ready stays. Folders stay while anything is in them or below.
    """
    content = ["user_id", "file_hash"]
    cancelled = flows.join(ended.where("outcome = 'cancelled'").select(*FLOW).distinct(), FLOW, "left_semi")
    ready = flows.join(ended.where("outcome = 'ready'").select(*FLOW).distinct(), FLOW, "left_semi")
    undone = cancelled.join(ready.select(*content), content, "left_anti")
    gone = undone.select(*content).distinct()
    out = delete_files(lib, lib["files"].join(gone, content, "left_semi").select("user_id", "file_id"))
    for name in ("image_index", "passages"):
        if name in lib:
            out[name] = lib[name].join(gone, content, "left_anti")
    return out, removable_folders(undone, out["files"])


# ---------------------------------------------------------------- backlog
def backlog_stream(stage_events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest state of every job in a keyed log; `current_backlog` counts it at any time."""
    row = F.struct("ts", "event_id", "state", "attempt", "reason")
    jobs = stage_events.groupBy("user_id", "flow_id", "stage").agg(F.max(row).alias("r"))
    changed = jobs.select("user_id", "flow_id", "stage", "r.*")
    return _start(changed, checkpoint, lambda df, i: append_changes(df, i, path), mode="update")


def current_backlog(spark: SparkSession, path: str) -> DataFrame:
    return backlog(spark.read.parquet(path))


# ---------------------------------------------------------------- faces
def assign_faces_stream(
    new_faces: DataFrame, known_faces: Callable[[], DataFrame], path: str, checkpoint: str, threshold: float
) -> StreamingQuery:
    """Assign every micro-batch of faces against the known ones and those assigned before it.

    Micro-batches are the serialisation: one runs at a time, and inside it the assignment is distributed.
    """
    columns = ["user_id", "file_id", "face_id", "person_id", "embedding"]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = known_faces().select(*columns).withColumn("person_id", F.col("person_id").cast("string"))
        if batch_id > 0:
            earlier = spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
            # a rescanned file counts with its last scan only
            last = earlier.groupBy("user_id", "file_id").agg(F.max("batch_id").alias("batch_id"))
            seen = earlier.join(last, ["user_id", "file_id", "batch_id"]).select(*columns)
            known = known.join(last, ["user_id", "file_id"], "left_anti").unionByName(seen)
        append_changes(assign_faces(batch, known, threshold).select(*columns, "score"), batch_id, path)

    return _start(new_faces, checkpoint, each)


def replay(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A parquet table of a folder, one file or a folder of files, as a file stream.

    A stream's path must be a folder unless it is a pattern; this one matches only the table itself.
    """
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run an append stream over what is there and return what it wrote."""
    spark = stream.sparkSession
    path = shared_dir(spark, "stream")
    _start(stream, f"{path}-checkpoint", lambda df, i: append_changes(df, i, path), mode).awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch_id int").parquet(path).drop("batch_id")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
