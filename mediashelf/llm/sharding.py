"""Sharding: groups that must stay together go, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediashelf.session import cut_lineage

#: Bundles of small groups per shard: the heap sees at most twice as many units, however many groups there are.
BUNDLES = 256

#: Rows that are numbered together.
CHUNK_ROWS = 1_000

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def longest_first(units: list[tuple[str, int, int]], shards: int) -> list[tuple[str, int, int]]:
    """(unit, shard, first slot) for units (unit, bytes, rows): by falling size, each to the shard with the least bytes."""
    heap, used, out = [(0, s) for s in range(shards)], [0] * shards, []
    for unit, size, rows in sorted(units, key=lambda u: (-u[1], u[0])):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        out.append((unit, s, used[s]))
        used[s] += rows
    return out


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, *, group: Column | None = None, size: Column | None = None, bundles: int = BUNDLES) -> DataFrame:
    """Every row with `size`, `text_crc32`, `shard` and `slot`; sizes of shards are near equal (law `bytes`).

    `group` (default: the text) says which rows must stay together, `size` (default: UTF-8 bytes + 16) what a row weighs.
    A group larger than 1 / (shards * bundles) of all bytes is a unit of its own - there are fewer than shards * bundles of
    them - and all others fall by hash into shards * bundles units. So the heap handles a number of units set by the
    parameters, in one small task, and a shard exceeds the mean by at most about one unit. Rows learn their unit's shard from
    a broadcast of the same proven bound. Slots are numbered in chunks of about CHUNK_ROWS within a unit, each chunk
    starting where the ones before it end, so a group that holds a third of all rows is numbered by many tasks.

    Null and empty texts are one group (no bytes); rows that are repeated get slots of their own; no rows give no rows; input columns
    named like a result are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    together = F.md5(body) if group is None else F.md5(F.coalesce(group.cast("string"), F.lit("")))
    weight = F.octet_length(body).cast("long") + 16 if size is None else size
    marked = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT),
        weight.alias("size"), F.crc32(body).alias("text_crc32"), together.alias("_llm_group"), F.xxhash64(key, text).alias("_llm_at"),
    )
    groups = cut_lineage(marked.groupBy("_llm_group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("bytes")).head()[0] or 0
    most = shards * bundles
    large = F.col("bytes") * most > F.lit(total)
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("_llm_group"), F.lit(most)).cast("string"))
    units = groups.groupBy(F.when(large, F.col("_llm_group")).otherwise(bundle).alias("_llm_unit")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [row for b in batches for row in zip(b["_llm_unit"], b["bytes"], b["rows"], strict=True)]
        rows = {u: n for u, _, n in held}
        out = pd.DataFrame(longest_first(held, shards), columns=["_llm_unit", "_llm_shard", "_llm_first"])
        yield out.assign(**{"_llm_chunks": [-(-rows[u] // CHUNK_ROWS) for u in out["_llm_unit"]]})

    placed = cut_lineage(units.coalesce(1).mapInPandas(place, "_llm_unit string, _llm_shard int, _llm_first long, _llm_chunks int"))
    alone = F.broadcast(groups.where(large).select(F.col("_llm_group"), F.lit(True).alias("_llm_alone")))
    rows = marked.join(alone, "_llm_group", "left").withColumn("_llm_unit", F.when(F.col("_llm_alone"), F.col("_llm_group")).otherwise(bundle)).drop("_llm_alone", "_llm_group")
    rows = rows.join(F.broadcast(placed), "_llm_unit").withColumn("_llm_chunk", F.pmod("_llm_at", "_llm_chunks"))
    counts = rows.groupBy("_llm_unit", "_llm_chunk").agg(F.count("*").alias("n"), F.first("_llm_first").alias("_llm_first"))
    earlier = Window.partitionBy("_llm_unit").orderBy("_llm_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_llm_unit", "_llm_chunk", (F.col("_llm_first") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("_llm_start"))
    within = Window.partitionBy("_llm_unit", "_llm_chunk").orderBy(F.col(key), "text_crc32", "size")
    numbered = rows.drop("_llm_first", "_llm_chunks").join(starts, ["_llm_unit", "_llm_chunk"]).withColumn("slot", F.col("_llm_start") + F.row_number().over(within) - 1)
    keep = [c for c in docs.columns if c.lower() not in RESULT]
    return numbered.select(
        *(F.col(f"`{c}`") for c in keep), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_llm_shard").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
