"""Keyed writes. Spark tables here are immutable snapshots: an upsert builds the next snapshot.

Write the result to a new location and swap; never overwrite the files being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key. `order` sorts newest first.

    row_number() = 1 lets Spark drop superseded versions before the shuffle (window group limit), so a key
    with many versions never gathers in one task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace by key; the newest update wins over the others and over the base row.

    Columns that only the base has (facts written by other stages) are kept from the base row.
    """
    new = latest(updates, keys, order)
    shared = [c for c in base.columns if c in new.columns and c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in shared], F.lit(True).alias("_hit"))
    joined = base.join(n, keys, "full_outer")
    hit = F.col("_hit").isNotNull()
    return joined.select(
        *[
            F.col(c) if c in keys or c not in shared else F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            for c in base.columns
        ]
    )


def object_id(*parts: Column) -> Column:
    """A deterministic row id: the same key always replaces itself."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def upsert_image_index(index: DataFrame, updates: DataFrame, order: list[Column]) -> DataFrame:
    """One vector row per (user_id, embed_model, file_hash); a re-indexed file replaces its row whole."""
    keys = ["user_id", "embed_model", "file_hash"]
    new = latest(updates, keys, order).select(*index.columns)
    return (
        index.join(new, keys, "left_anti")
        .unionByName(new)
        .withColumn("object_id", object_id(F.col("user_id"), F.col("file_hash")))
    )


def replace_documents(passages: DataFrame, new: DataFrame) -> DataFrame:
    """All passages of a re-indexed document are replaced, leftovers of a longer old version included."""
    keys = ["user_id", "file_hash"]
    return passages.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def apply_patch(files: DataFrame, patches: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Overwrite only the fields a patch names.

    `patches` has the keys, a column `fields` (array of field names present) and nullable value columns: a
    named field may be set to null, an unnamed one stays. Of several patches of a key that name a field the one last by `order`, a
    further column, counts (without it, or where it ties, the greatest value).
    """
    values = [c for c in patches.columns if c not in (*keys, "fields", order)]
    unknown = set(values) - set(files.columns)
    if unknown:
        raise ValueError(f"not file columns: {sorted(unknown)}")
    at = F.lit(0) if order is None else F.col(order)

    def last(c: str) -> Column:
        return F.max(F.when(F.array_contains("fields", c), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(f"_p_{c}")

    def patched(c: str) -> Column:
        return F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}")["value"]).otherwise(F.col(c)).alias(c)

    p = patches.groupBy(*keys).agg(*map(last, values)) if values else patches.select(*keys).distinct()
    return files.join(p, keys, "left").select(*[patched(c) if c in values else F.col(c) for c in files.columns])


def patch_people(people: DataFrame, patches: DataFrame) -> DataFrame:
    """Rename (trimmed, 60 characters, empty clears) and/or hide. Absent fields stay.

    `patches`: user_id, person_id, has_name, new_name, new_hidden (null = unchanged), and `ts` if a person may have several: per
    field the last one counts (without ts, or where it ties, the greatest value).
    """
    from ..functions.text import strip

    clean = F.nullif(F.substring(strip(F.col("new_name")), 1, 60), F.lit(""))
    at = F.col("ts") if "ts" in patches.columns else F.lit(0)
    named = F.max(F.when(F.col("has_name"), F.struct(at.alias("at"), F.col("new_name").alias("value"))))
    hidden = F.max(F.when(F.col("new_hidden").isNotNull(), F.struct(at.alias("at"), F.col("new_hidden").alias("value"))))
    once = patches.groupBy("user_id", "person_id").agg(named.alias("_named"), hidden.alias("_hidden"))
    once = once.select("user_id", "person_id", F.col("_named").isNotNull().alias("has_name"), F.col("_named")["value"].alias("new_name"), F.col("_hidden")["value"].alias("new_hidden"))
    return people.join(once, ["user_id", "person_id"], "left").select(
        *[
            F.when(F.coalesce("has_name", F.lit(False)), clean).otherwise(F.col("name")).alias("name")
            if c == "name"
            else F.coalesce("new_hidden", "hidden").alias("hidden")
            if c == "hidden"
            else F.col(c)
            for c in people.columns
        ]
    )
