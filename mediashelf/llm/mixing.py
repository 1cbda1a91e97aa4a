"""Mixing sources to target weights: a number of words per source, reached by repeating or leaving out documents."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediashelf.session import cut_lineage

from .common import uniform, without, word_count

WEIGHTS = (5, 2, 1)
RESULT = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, max_times: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh `weights`, repeating. They share `share_percent` of all words by weight; no
    target exceeds `max_times` the source's size, and what is above goes to the others by weight. Such shares are all of one
    level, `weight * level`, or at their limit: with sources in the order in which a rising level meets their limits, each row
    knows the level that would hold if all before it were at their limits, and the first whose limit isn't below it gives the
    level. Whole numbers decide, so the outcome is the same everywhere. The windows see one row per source, not documents.
    """
    lcm = math.lcm(*weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("meets", "rank")
    before, onward = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    weighed = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    limits = weighed.withColumns({"cap": F.col("source_size") * max_times, "meets": F.col("source_size") * max_times * F.floor(F.lit(lcm) / F.col("w"))})
    levels = limits.withColumns({
        "num": F.sum("source_size").over(whole) * share_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "den": 100 * F.sum("w").over(onward),
    })
    below = wide("num") * wide("w") <= wide("cap") * wide("den")
    first = lambda c: F.first(F.when(below, F.col(c)), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, 0))
    settled = levels.withColumns({"level_num": first("num"), "level_den": first("den")})
    share = (F.col("w") * F.col("level_num")).cast("double") / F.col("level_den").cast("double")
    return settled.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *,
    weights: Sequence[int] = WEIGHTS, share_percent: int = 150, max_times: int = 2, seed: int = 42,
) -> DataFrame:
    """Every document with its size in words, its source's size and target, its copies and the words taken with them.

    A source's repetition rate is target / size. A document is taken floor(rate) times, plus once more if a number drawn
    from the seed and its key is below the fraction: reruns agree, and no document is taken more than `max_times`.

    Only one row per source and narrow numbers are exchanged; the table of sources is written, so Spark knows its size and
    ships it to the documents if it is below the broadcast threshold, or else joins by a shuffle that splits hot sources.

    Null text has size 0 and is kept with its copies; a null source is a source of its own; rows with one key (null too) draw the
    same number, so repeated rows are repeated alike; no documents give no rows; input columns named like a result
    (`size source_size target copies taken`) are replaced.
    """
    sized = docs.select("*", word_count(F.col(text)).alias("_llm_words"), F.col(source).alias("_llm_of"))
    sizes = sized.groupBy(F.col("_llm_of").alias("source")).agg(F.sum("_llm_words").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share_percent, max_times)).select(
        F.col("source").alias("_llm_source"), F.col("source_size").alias("_llm_source_size"), F.col("target").alias("_llm_target")
    )
    rate = F.when(F.col("_llm_source_size") > 0, F.col("_llm_target") / F.col("_llm_source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(uniform(seed, F.col(key)) < rate - F.floor(rate), 1).otherwise(0)
    joined = sized.join(targets, F.col("_llm_of").eqNullSafe(F.col("_llm_source"))).withColumn("_llm_copies", copies.cast("int"))
    keep = [c for c in docs.columns if c.lower() not in RESULT]
    return joined.select(
        *(F.col(f"`{c}`") for c in keep), F.col("_llm_words").alias("size"), F.col("_llm_source_size").alias("source_size"),
        F.col("_llm_target").alias("target"), F.col("_llm_copies").alias("copies"), (F.col("_llm_words") * F.col("_llm_copies")).alias("taken"),
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken, numbered by `copy` from 1."""
    return without(mixed, "copy").where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
