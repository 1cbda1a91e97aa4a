"""Library queries over files: predicates, cards, facets, keyset pages, structured filters.

Operators take and return DataFrames and never collect. Tables are keyed by user_id; a user with a large share
of all rows is safe because aggregates combine before the shuffle and top-n windows are limited before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as fv
from ..functions.dates import event_time
from ..functions.text import ancestors

PLACE_COLUMNS = ("place_area", "place_city", "place_region", "place_country")


# ---------------------------------------------------------------- predicates
def visible(files: DataFrame) -> DataFrame:
    """Stored in the cloud and not failed. Both predicates reach the Parquet scan."""
    return files.filter((F.col("status") != "failed") & F.col("provider_file_id").isNotNull())


def has_tag(files: DataFrame, tag: str) -> DataFrame:
    return files.filter(F.array_contains("tags", tag))


def under(folder: Column, path: str) -> Column:
    """The folder itself or anything below it. A literal prefix: '%' and '_' have no special meaning."""
    return (folder == path) | folder.startswith(f"{path}/")


def in_folder(files: DataFrame, path: str) -> DataFrame:
    return files.filter(under(F.col("folder"), path))


def with_person(files: DataFrame, faces: DataFrame, person_id) -> DataFrame:
    return files.join(faces.filter(F.col("person_id") == person_id), ["user_id", "file_id"], "left_semi")


def select_for_reindex(files: DataFrame, model: str, everything: bool = False) -> DataFrame:
    """Work lists: images of another embedding model, images never scanned for faces, untitled documents."""
    live = visible(files)
    image, doc = F.col("media_type") == "image", F.col("media_type") == "document"
    work = F.filter(
        F.array(
            F.when(image & (F.lit(everything) | ~F.col("embed_model").eqNullSafe(F.lit(model))), "embed"),
            F.when(image & (F.lit(everything) | ~F.col("faces_scanned")), "faces"),
            F.when(doc & (F.lit(everything) | F.col("title").isNull()), "docindex"),
        ),
        F.isnotnull,
    )
    return live.select("user_id", "file_id", F.explode(work).alias("work_kind"))


# ---------------------------------------------------------------- cards
def provider_key(provider_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fv.PROVIDERS.items() for x in pair])
    return F.try_element_at(table, provider_id.cast("int"))


def people_per_file(faces: DataFrame, people: DataFrame) -> DataFrame:
    """(user_id, file_id, people): visible people ordered by name, one entry per face."""
    shown = people.filter(~F.col("hidden")).select("user_id", "person_id", "name")
    entry = F.struct(F.col("name"), F.col("person_id").alias("id"))
    # named first, by name; then the unnamed (nulls last, as in the listing order of a database)
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col("name").isNull().alias("unnamed"), F.col("name"), F.col("person_id")))
    )
    return (
        faces.join(shown, ["user_id", "person_id"])
        .groupBy("user_id", "file_id")
        .agg(F.transform(ordered, lambda p: F.struct(p.person_id.alias("id"), p["name"].alias("name"))).alias("people"))
    )


def file_cards(files: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """What a client shows for a file. At most twenty faces per file bound the nested list."""
    viewable = F.col("provider_file_id").isNotNull() & (F.col("status") != "failed")
    joined = files.join(people_per_file(faces, people), ["user_id", "file_id"], "left")
    empty = F.array().cast("array<struct<id:bigint,name:string>>")
    return joined.select(
        "user_id",
        F.col("file_id").alias("id"),
        F.col("file_hash").alias("hash"),
        "name",
        "mime",
        "size",
        provider_key(F.col("provider_id")).alias("provider"),
        "status",
        "created_at",
        "taken_at",
        "width",
        "height",
        "camera",
        "kind",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("place_name").alias("place"),
        F.coalesce("media_type", F.lit("image")).alias("media_type"),
        "title",
        "page_count",
        "excerpt",
        F.nullif(F.col("folder"), F.lit("")).alias("folder"),
        F.coalesce("people", empty).alias("people"),
        (viewable & (F.coalesce("media_type", F.lit("image")) != "document")).alias("has_thumb"),
        viewable.alias("viewable"),
    )


# ---------------------------------------------------------------- top-k and facets
def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column, rank: str | None = None) -> DataFrame:
    """First k rows per key. Spark limits each partition's groups before shuffling when k is a literal."""
    out = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    out = out.filter(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def top_tags(files: DataFrame, n: int = 16) -> DataFrame:
    counts = (
        files.filter("status <> 'failed'")
        .select("user_id", F.explode("tags").alias("tag"))
        .groupBy("user_id", "tag")
        .agg(F.count("*").alias("n_files"))
    )
    return top_k(counts, ["user_id"], [F.desc("n_files"), F.asc("tag")], n)


def top_folders(files: DataFrame, n: int = 24) -> DataFrame:
    """First path segments with their file counts, subfolders included."""
    counts = (
        visible(files)
        .filter("folder <> ''")
        .groupBy("user_id", F.split_part("folder", F.lit("/"), F.lit(1)).alias("folder"))
        .agg(F.count("*").alias("n_files"))
    )
    return top_k(counts, ["user_id"], [F.desc("n_files"), F.asc("folder")], n)


def known_places(files: DataFrame) -> DataFrame:
    return (
        files.filter("place_name is not null")
        .select("user_id", F.explode(F.array(*PLACE_COLUMNS)).alias("place"))
        .filter("place <> ''")
        .distinct()
    )


# ---------------------------------------------------------------- pages
def encode_cursor(created_at: Column, file_id: Column) -> Column:
    """Opaque page cursor: URL-safe base64 of 'timestamp|id' without padding."""
    stamp = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = F.concat(stamp, F.lit("|"), file_id.cast("string"))
    return F.rtrim(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: str) -> tuple[str, str]:
    """(timestamp text, id) of a cursor made by `encode_cursor`; ValueError when it is not one."""
    import base64
    from datetime import datetime

    stamp, _, file_id = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().partition("|")
    datetime.fromisoformat(stamp.replace("Z", "+00:00"))
    if not file_id:
        raise ValueError("invalid cursor")
    return stamp, file_id


def list_files(
    files: DataFrame,
    limit: int = 30,
    cursor: str | None = None,
    tag: str | None = None,
    person=None,
    folder: str | None = None,
    faces: DataFrame | None = None,
) -> DataFrame:
    """One page of one user's visible files, newest first, with the cursor of the next page (null = last).

    Filter `files` to the user first. The page is limit + 1 rows taken as top-k per partition
    (TakeOrderedAndProject); only those rows meet in the final window.
    """
    df = visible(files)
    if tag:
        df = has_tag(df, tag)
    if folder:
        df = in_folder(df, folder)
    if person is not None:
        df = with_person(df, faces, person)
    if cursor:
        stamp, last_id = decode_cursor(cursor)
        ts, fid = F.lit(stamp).cast("timestamp"), F.lit(last_id).cast(files.schema["file_id"].dataType)
        at = F.date_trunc("millisecond", "created_at")
        df = df.filter((F.col("created_at") <= ts) | (at == ts))
        df = df.filter((at < ts) | ((at == ts) & (F.col("file_id") < fid)))
    newest = [F.date_trunc("millisecond", "created_at").desc(), F.desc("file_id")]
    page = df.orderBy(*newest).limit(limit + 1)
    w = W.orderBy(*newest)  # limit + 1 rows only
    rows = page.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.max("_n").over(W.partitionBy()))
    more = (F.col("_n") == limit) & (F.col("_all") > limit)
    next_cursor = F.when(more, encode_cursor(F.col("created_at"), F.col("file_id")))
    return rows.withColumn("next_cursor", next_cursor).filter(F.col("_n") <= limit).drop("_n", "_all")


def newest(allow: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """Answer of a query that only filters: its k newest files."""
    at = event_time(F.col("taken_at"), F.col("created_at"))
    hits = allow.select("query_id", "user_id", "file_hash").join(
        files.select("user_id", "file_hash", at.alias("event_time")), ["user_id", "file_hash"]
    )
    return top_k(hits, ["query_id"], [F.desc("event_time"), F.asc("file_hash")], k, rank="position")


# ---------------------------------------------------------------- joins by key
def hydrate(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Ranked hashes back to rows; hits whose file is gone are dropped, the rank columns stay."""
    return hits.join(files, ["user_id", "file_hash"])


def lookup_files(keys: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(keys.distinct(), keys.columns, "left_semi")


def provider_status(users: DataFrame, connections: DataFrame) -> DataFrame:
    """Every known provider per user with a connected flag. The four providers are exploded, not joined."""
    known = F.array(*[F.struct(F.lit(i).alias("provider_id"), F.lit(k).alias("provider")) for i, k in fv.PROVIDERS.items()])
    grid = users.select("user_id").distinct().select("user_id", F.inline(known))
    live = connections.select("user_id", "provider_id").distinct().withColumn("connected", F.lit(True))
    return grid.join(live, ["user_id", "provider_id"], "left").withColumn(
        "connected", F.coalesce("connected", F.lit(False))
    )


def storage_rollup(quota: DataFrame) -> DataFrame:
    """Totals per user and provider, and per user (provider_id null). Failing providers are listed, not summed."""
    ok = ~F.col("failing")
    free = F.greatest(F.lit(0.0), F.col("total") - F.col("used"))
    sums = {"total": F.col("total"), "used": F.col("used"), "free": free}
    return (
        quota.rollup("user_id", "provider_id")
        .agg(
            *[F.sum(F.when(ok, c)).alias(name) for name, c in sums.items()],
            F.count(F.when(F.col("failing"), 1)).alias("n_failing"),
            F.grouping_id().alias("_g"),
        )
        .filter("_g < 3")
        .withColumn("is_overall", F.col("_g") == 1)
        .drop("_g")
    )


# ---------------------------------------------------------------- structured filters
FILTER_FIELDS = ("date_from", "date_to", "months", "kinds", "places", "person_ids")


def has_filters(queries: DataFrame) -> Column:
    """True when a query restricts anything; such a query with no matching file has an empty answer."""
    lists = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("months", "kinds", "places", "person_ids")]
    out = F.col("date_from").isNotNull() | F.col("date_to").isNotNull()
    for c in lists:
        out = out | c
    return out


def with_all_people(faces: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, user_id, file_id) of files that show every person a query names (relational division)."""
    asked = queries.select("query_id", "user_id", F.array_distinct("person_ids").alias("ids")).filter(F.size("ids") > 0)
    wanted = asked.select("query_id", "user_id", F.size("ids").alias("n"), F.explode("ids").alias("person_id"))
    seen = faces.select("user_id", "person_id", "file_id").distinct()
    return (
        wanted.join(seen, ["user_id", "person_id"])
        .groupBy("query_id", "user_id", "file_id", "n")
        .agg(F.count("*").alias("found"))
        .filter("found = n")
        .select("query_id", "user_id", "file_id")
    )


def resolve_filters(queries: DataFrame, files: DataFrame, faces: DataFrame) -> DataFrame:
    """(query_id, user_id, file_hash, event_time) allowed by each filtering query. No cap.

    Queries without filters give no rows here: combine with `has_filters` to tell "anything" from "nothing".
    Queries that name people start from the (small) set of files showing them; the others join on user_id with
    the remaining predicates inside the join, so only matches leave it.
    """
    wanted = queries.select("query_id", "user_id", *FILTER_FIELDS).filter(has_filters(queries))
    f = visible(files).select(
        "user_id",
        "file_id",
        "file_hash",
        "kind",
        event_time(F.col("taken_at"), F.col("created_at")).alias("event_time"),
        F.array(*[F.lower(c) for c in PLACE_COLUMNS]).alias("_places"),
    )

    def free(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) == 0

    day_after = F.date_add("date_to", 1).cast("timestamp")
    match = (
        (F.col("date_from").isNull() | (F.col("event_time") >= F.col("date_from").cast("timestamp")))
        & (F.col("date_to").isNull() | (F.col("event_time") < day_after))
        & (free("months") | F.array_contains("months", F.month("event_time")))
        & (free("kinds") | F.array_contains("kinds", F.col("kind")))
        & (free("places") | F.coalesce(F.arrays_overlap("_low_places", F.array_compact("_places")), F.lit(False)))
    )
    wanted = wanted.withColumn("_low_places", F.transform("places", F.lower))
    named = wanted.filter(~free("person_ids"))
    by_people = with_all_people(faces, named).join(f, ["user_id", "file_id"])
    out = ["query_id", "user_id", "file_hash", "event_time"]
    with_people = by_people.join(named.drop("user_id"), "query_id").filter(match).select(*out)
    without = wanted.filter(free("person_ids")).join(f, "user_id").filter(match).select(*out)
    return with_people.unionByName(without)


def within(candidates: DataFrame, queries: DataFrame, allow: DataFrame) -> DataFrame:
    """Restrict (query_id, file_hash) candidates to the allow-list of queries that filter; others pass."""
    filtering = queries.filter(F.col("filtered")).select("query_id")
    free = candidates.join(filtering, "query_id", "left_anti")
    kept = candidates.join(filtering, "query_id", "left_semi").join(allow, ["query_id", "file_hash"], "left_semi")
    return free.unionByName(kept)


def folder_ancestors(files: DataFrame, depth: int = 1) -> DataFrame:
    """(user_id, provider_id, path) of every non-root folder above a file."""
    return files.filter("folder <> ''").select(
        "user_id", "provider_id", F.explode(ancestors(F.col("folder"), depth)).alias("path")
    )
