"""Session settings and the few helpers that need the session itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings the operators were planned with. They are defaults for a new session; a cluster's own win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Above this many rows a query batch is joined by a shuffle instead of being shipped to every task.
SMALL_BATCH = 1024


def build_session(master: str | None = None, app: str = "mediashelf", **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments override (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory under the cluster's checkpoint folder; local sessions get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's state to the shared folder and read it back.

    A written table survives the loss of executors, and its size is known to the next plan.
    """
    path = shared_dir(df.sparkSession, "state")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """`cut_lineage`, and how many rows met the condition - counted while writing, without a second job."""
    seen = Observation()
    written = cut_lineage(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return written, seen.get["n"]


def collect_small(df: DataFrame, limit: int = SMALL_BATCH) -> list | None:
    """The rows if there are at most `limit` of them, else None. Never pulls more than limit + 1 rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
