"""People: counts and covers, listing, naming, merges, and what deletes do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_and_count, cut_lineage
from .library import top_k, under

PERSON = ["user_id", "person_id"]


def face_stats(faces: DataFrame) -> DataFrame:
    """Per person: face_count and cover_face_id (highest score, unknown scores last, then oldest).

    The cover is a minimum over structs, so it combines before the shuffle: a person with a large share of all
    faces costs one row per map task.
    """
    rank = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), F.col("created_at"), F.col("face_id"))
    return (
        faces.filter("person_id is not null")
        .groupBy(*PERSON)
        .agg(F.count("*").alias("face_count"), F.min_by("face_id", rank).alias("cover_face_id"))
    )


def cover_faces(faces: DataFrame) -> DataFrame:
    return face_stats(faces).select(*PERSON, "cover_face_id")


def refresh_people(people: DataFrame, faces: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Recount (all or the touched) people; an unnamed person left without faces is dropped."""
    stats = face_stats(faces)
    if touched is not None:
        touched = touched.select(*PERSON).distinct().withColumn("_touched", F.lit(True))
        stats = stats.join(touched.drop("_touched"), PERSON, "left_semi")
    base = people.drop("face_count", "cover_face_id") if touched is None else people
    if touched is None:
        fresh = base.join(stats, PERSON, "left").withColumn("face_count", F.coalesce("face_count", F.lit(0)))
        return fresh.filter("not (face_count = 0 and name is null)")
    new = stats.withColumnsRenamed({"face_count": "_n", "cover_face_id": "_cover"})
    hit = F.col("_touched").isNotNull()
    return (
        base.join(touched, PERSON, "left")
        .join(new, PERSON, "left")
        .withColumn("face_count", F.when(hit, F.coalesce("_n", F.lit(0))).otherwise(F.col("face_count")))
        .withColumn("cover_face_id", F.when(hit, F.col("_cover")).otherwise(F.col("cover_face_id")))
        .filter(~(hit & (F.col("face_count") == 0) & F.col("name").isNull()))
        .drop("_touched", "_n", "_cover")
    )


def named_people(people: DataFrame) -> DataFrame:
    return people.filter("name is not null and not hidden").select("user_id", "person_id", "name")


def people_list(
    people: DataFrame,
    faces: DataFrame,
    files: DataFrame,
    include_singles: bool = False,
    hidden: bool = False,
    limit: int = 300,
) -> DataFrame:
    """The people page: named first, then the most photographed; unnamed ones need two faces unless asked for.

    Only the listed rows are joined to their cover face and its file.
    """
    shown = people.filter(F.col("hidden") == hidden)
    if not hidden:
        shown = shown.filter(F.col("name").isNotNull() | (F.col("face_count") >= (1 if include_singles else 2)))
    order = [F.col("name").isNull().asc(), F.desc("face_count"), F.asc("person_id")]
    listed = top_k(shown, ["user_id"], order, limit, rank="position")
    cover = faces.select("user_id", F.col("face_id").alias("cover_face_id"), "file_id", "bbox")
    size = files.select("user_id", "file_id", "width", "height")
    return (
        listed.join(cover, ["user_id", "cover_face_id"], "left")
        .join(size.withColumn("_stored", F.lit(True)), ["user_id", "file_id"], "left")
        .select(
            "user_id", "person_id", "name", "hidden", "face_count", "position",
            F.when(F.col("_stored"), F.col("file_id")).alias("cover_file_id"),
            F.when(F.col("_stored"), F.col("bbox")).alias("bbox"), "width", "height",
        )
    )


def merge_target(selected: DataFrame, by: list[str]) -> DataFrame:
    """Of the people selected together the one that survives: named, then most faces, then lowest id."""
    order = [F.col("name").isNotNull().desc(), F.desc("face_count"), F.asc("person_id")]
    return top_k(selected, by, order, 1)


def merge_sources(ids: Column, target: Column) -> Column:
    """Distinct ids without the target."""
    return F.array_except(F.array_distinct(ids), F.array(target))


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """People whose faces changed: those seen before and those seen now."""
    seen = before.select(*PERSON).unionByName(after.select(*PERSON))
    return seen.filter("person_id is not null").distinct()


def missing_people(requests: DataFrame, people: DataFrame) -> DataFrame:
    """(request_id, user_id, person_id) asked for but not the user's; any row rejects the whole request."""
    asked = requests.select("request_id", "user_id", F.explode(F.array_distinct("person_ids")).alias("person_id"))
    return asked.join(people, PERSON, "left_anti")


def name_conflicts(people: DataFrame) -> DataFrame:
    """People of one user that share a name, ignoring case and surrounding blanks."""
    key = F.lower(F.trim("name")).alias("name_key")
    named = people.filter("name is not null").select(*PERSON, "name", key)
    shared = named.groupBy("user_id", "name_key").agg(F.count("*").alias("n_people")).filter("n_people > 1")
    return named.join(shared, ["user_id", "name_key"])


# ---------------------------------------------------------------- aliases and merges
def compress_aliases(alias: DataFrame) -> DataFrame:
    """Follow merge chains src -> dst to their end by pointer jumping.

    Each round doubles the reach and is written; rounds end when nothing moves. Several merges of one source keep the newest,
    a merge into itself counts for nothing. Chains that still move when they would have passed every alias run in a circle: an error.
    """
    newest = alias.filter("src <> dst").groupBy("user_id", "src").agg(F.max_by("dst", F.struct("ts", "dst")).alias("dst"))
    now, n = cut_and_count(newest, F.lit(True))
    reach = 1
    while True:
        ahead = now.select("user_id", F.col("src").alias("dst"), F.col("dst").alias("_further"))
        step = now.join(ahead, ["user_id", "dst"], "left").select(
            "user_id", "src", F.coalesce("_further", "dst").alias("dst"), F.col("_further").isNotNull().alias("_moved")
        )
        now, moved = cut_and_count(step, F.col("_moved"))
        now, reach = now.drop("_moved"), reach * 2
        if not moved:
            return now
        if reach > 2 * n:
            raise ValueError("merges form a circle")


def resolve_alias(faces: DataFrame, alias: DataFrame) -> DataFrame:
    """Point faces of merged-away people at the person they became."""
    final = compress_aliases(alias).select("user_id", F.col("src").alias("person_id"), F.col("dst").alias("_dst"))
    return faces.join(final, PERSON, "left").select(
        *[F.coalesce("_dst", "person_id").alias("person_id") if c == "person_id" else F.col(c) for c in faces.columns]
    )


def merge_people(
    faces: DataFrame, people: DataFrame, merges: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge sources into targets. Returns (faces, people, alias).

    `merges`: request_id, user_id, target, sources, ts. A request naming somebody else's people is rejected whole.
    A target without a name takes the name of its lowest-numbered named source.
    """
    asked = merges.select("request_id", "user_id", F.concat("sources", F.array("target")).alias("person_ids"))
    bad = missing_people(asked, people).select("request_id").distinct()
    valid = merges.join(bad, "request_id", "left_anti")
    alias = valid.select(
        "user_id", F.explode(merge_sources(F.col("sources"), F.col("target"))).alias("src"), F.col("target").alias("dst"), "ts"
    )
    # the merges of a batch are read five times below
    moved = cut_lineage(compress_aliases(alias).select("user_id", F.col("src").alias("person_id"), F.col("dst").alias("_dst")))
    new_faces = faces.join(moved, PERSON, "left").select(
        *[F.coalesce("_dst", "person_id").alias("person_id") if c == "person_id" else F.col(c) for c in faces.columns]
    )
    inherited = (
        moved.join(people.filter("name is not null").select(*PERSON, "name"), PERSON)
        .groupBy("user_id", "_dst")
        .agg(F.min_by("name", "person_id").alias("_name"))
        .withColumnRenamed("_dst", "person_id")
    )
    kept = people.join(moved, PERSON, "left_anti").join(inherited, PERSON, "left")
    renamed = kept.withColumn("name", F.coalesce("name", "_name")).drop("_name")
    targets = moved.select("user_id", F.col("_dst").alias("person_id"))
    return new_faces, refresh_people(renamed, new_faces, targets), alias


def store_faces(
    faces: DataFrame, people: DataFrame, files: DataFrame, scanned: DataFrame, found: DataFrame, alias: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace the faces of freshly scanned files. Returns (faces, people, files).

    `scanned` (user_id, file_id) lists every scanned file, those without a face too; `found` has the faces.
    Faces of merged people go to the survivor; unknown person ids become new, unnamed people.
    """
    key = ["user_id", "file_id"]
    fresh = cut_lineage(resolve_alias(found, alias))
    before = faces.join(scanned, key, "left_semi")
    new_faces = faces.join(scanned, key, "left_anti").unionByName(fresh.select(*faces.columns))
    newcomers = (
        fresh.groupBy(*PERSON)
        .agg(F.min("created_at").alias("created_at"))
        .join(people, PERSON, "left_anti")
        .withColumn("hidden", F.lit(False))
    )
    grown = people.unionByName(newcomers, allowMissingColumns=True)
    mark = scanned.select(*key).distinct().withColumn("_scanned", F.lit(True))
    new_files = (
        files.join(mark, key, "left")
        .withColumn("faces_scanned", F.coalesce("_scanned", "faces_scanned"))
        .drop("_scanned")
    )
    return new_faces, refresh_people(grown, new_faces, touched(before, fresh)), new_files


# ---------------------------------------------------------------- deletes
def delete_files(lib: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Delete files with their faces, vectors and passages, and recount the people who were in them.

    `lib` holds files, faces, people and optionally image_index and passages; `gone` (user_id, file_id).
    """
    key = ["user_id", "file_id"]
    rows = lib["files"].join(gone, key, "left_semi")
    out = dict(lib)
    out["files"] = lib["files"].join(gone, key, "left_anti")
    out["faces"] = lib["faces"].join(gone, key, "left_anti")
    lost = lib["faces"].join(gone, key, "left_semi").filter("person_id is not null").select(*PERSON)
    out["people"] = refresh_people(lib["people"], out["faces"], lost)
    for name in ("image_index", "passages"):
        if name in lib:
            out[name] = lib[name].join(rows.select("user_id", "file_hash"), ["user_id", "file_hash"], "left_anti")
    return out


def delete_folder(lib: dict[str, DataFrame], path: str, failed: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete everything under a folder for the users in `lib`. Returns (library, summary per user).

    `failed` (user_id, file_id): deletes the cloud refused; these stay. Folders go only for users without
    failures. Summary: n_files, n_failed, n_folders_removed.
    """
    from .ingest import removable_folders

    inside = lib["files"].filter(under(F.col("folder"), path))
    if failed is None:
        refused = inside.filter(F.lit(False)).select("user_id", "file_id")
    else:
        refused = inside.join(failed, ["user_id", "file_id"], "left_semi").select("user_id", "file_id")
    gone = inside.join(refused, ["user_id", "file_id"], "left_anti")
    out = delete_files(lib, gone.select("user_id", "file_id"))
    clean = gone.join(refused, "user_id", "left_anti")
    folders = removable_folders(clean, out["files"], None, depth=path.count("/") + 1)
    per_folder = folders.groupBy("user_id").agg(F.count("*").alias("n_folders_removed"))
    n_failed = refused.groupBy("user_id").agg(F.count("*").alias("n_failed"))
    summary = inside.groupBy("user_id").agg(F.count("*").alias("n_all"))
    summary = summary.join(n_failed, "user_id", "left").join(per_folder, "user_id", "left").na.fill(0)
    return out, summary.select(
        "user_id", (F.col("n_all") - F.col("n_failed")).alias("n_files"), "n_failed", "n_folders_removed"
    )
