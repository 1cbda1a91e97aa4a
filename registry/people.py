"""People: stats, lists, merges, deletes, face clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.operators import faces as fc
from mediashelf.operators import people as pp
from mediashelf.session import cut_lineage
from mediashelf.sources import sinks

from . import query

STATS = """fs as (select user_id, person_id, count(*) as face_count from faces where person_id is not null group by all),
  cv as (select user_id, person_id, face_id as cover_face_id from (select *, row_number() over (partition by user_id, person_id order by score desc nulls last, created_at, face_id) as r from faces) x where r = 1),
  rp as (select p.user_id, p.person_id, p.name, p.hidden, p.created_at, coalesce(face_count, 0) as face_count, cover_face_id from people p left join fs using (user_id, person_id) left join cv using (user_id, person_id)
    where coalesce(face_count, 0) > 0 or name is not null)"""
BASE = ("faces", "people")


def refreshed(t):
    return pp.refresh_people(t("people"), t("faces"))


@query("agg_refresh_people", f"with {STATS} select person_id, name, face_count, cover_face_id from rp", BASE)
def _(t, spark):
    return refreshed(t).select("person_id", "name", "face_count", "cover_face_id")


@query("win_cover_face", f"with {STATS} select person_id, cover_face_id from cv", BASE)
def _(t, spark):
    return pp.cover_faces(t("faces")).select("person_id", "cover_face_id")


@query("agg_named_people", "select user_id, person_id, name from people where name is not null and not hidden", ("people",))
def _(t, spark):
    return pp.named_people(t("people"))


LISTED = f"""{STATS}, l as (select *, row_number() over (partition by user_id order by name is null, face_count desc, person_id) as position from rp where not hidden and (name is not null or face_count >= 2))"""


def listing(t):
    faces = t("faces").withColumn("bbox", F.array("score"))
    return pp.people_list(refreshed(t), faces, t("files"))


@query("sort_people", f"with {LISTED} select user_id, person_id, name, face_count, position from l where position <= 300", BASE)
def _(t, spark):
    return listing(t).select("user_id", "person_id", "name", "face_count", F.col("position").cast("long").alias("position"))


@query(
    "join_people_cover",
    f"""with {LISTED} select l.user_id, l.person_id, fi.file_id as cover_file_id, fi.width, fi.height from l left join faces f on f.user_id = l.user_id and f.face_id = l.cover_face_id
    left join files fi on fi.user_id = f.user_id and fi.file_id = f.file_id where position <= 300""",
    ("faces", "people", "files"),
)
def _(t, spark):
    return listing(t).select("user_id", "person_id", "cover_file_id", "width", "height")


@query(
    "pick_merge_target",
    f"with {STATS} select user_id, month_no, person_id from (select *, row_number() over (partition by user_id, month_no order by name is not null desc, face_count desc, person_id) as r from (select *, cast(day(created_at) as bigint) as month_no from rp) x) y where r = 1",
    BASE,
)
def _(t, spark):
    chosen = refreshed(t).withColumn("month_no", F.dayofmonth("created_at").cast("long"))  # people selected together
    return pp.merge_target(chosen, ["user_id", "month_no"]).select("user_id", "month_no", "person_id")


PATCHES = """case when person_id % 4 = 0 then true else false end as has_name, case when person_id % 8 = 0 then '   ' when person_id % 4 = 0 then concat('  Renamed ', repeat('x', 70), cast(person_id as string)) end as new_name,
  case when person_id % 3 = 0 then not hidden end as new_hidden"""


@query(
    "patch_people",
    f"""with p as (select user_id, person_id, name, hidden, {PATCHES.replace('string', 'varchar')} from people)
    select person_id, case when has_name then nullif(substring(trim(new_name), 1, 60), '') else name end as name, coalesce(new_hidden, hidden) as hidden from p""",
    ("people",),
)
def _(t, spark):
    patches = t("people").selectExpr("user_id", "person_id", *[p.strip() for p in PATCHES.split(",\n") for p in _split(p)])
    return sinks.patch_people(t("people"), patches).select("person_id", "name", "hidden")


def _split(sql):
    head, _, tail = sql.partition(" as has_name, ")
    return [head + " as has_name", tail] if tail else [sql]


@query("set_touched_people", "select distinct user_id, person_id from (select user_id, person_id from faces where score < 0.5 union all select user_id, person_id from faces where score > 0.8) x", ("faces",))
def _(t, spark):
    return pp.touched(t("faces").filter("score < 0.5"), t("faces").filter("score > 0.8"))


@query(
    "check_owned_people",
    """with r as (select query_id as request_id, user_id, unnest(list_distinct([user_id + 5, user_id + 10 * (query_id % 40), user_id + query_id % 3, user_id + 5])) as person_id from keyword_queries)
    select request_id, user_id, person_id from r where not exists (select 1 from people p where p.user_id = r.user_id and p.person_id = r.person_id)""",
    ("keyword_queries", "people"),
)
def _(t, spark):
    ids = "array(user_id + 5, user_id + 10 * (query_id % 40), user_id + query_id % 3, user_id + 5) as person_ids"
    return pp.missing_people(t("keyword_queries").selectExpr("query_id as request_id", "user_id", ids), t("people"))


@query(
    "check_unique_person_name",
    """with p as (select user_id, person_id, upper(split_part(name, ' ', 1)) as name from people where name is not null), k as (select *, lower(trim(name)) as name_key, count(*) over (partition by user_id, lower(trim(name))) as n_people from p)
    select user_id, person_id, name, name_key, n_people from k where n_people > 1""",
    ("people",),
)
def _(t, spark):
    return pp.name_conflicts(t("people").withColumn("name", F.upper(F.split_part("name", F.lit(" "), F.lit(1)))))


# ---------------------------------------------------------------- aliases and merges
@query(
    "map_alias_resolve",
    """with recursive a as (select user_id, person_id as src, person_id + 5 as dst from people where person_id % 50 < 35),
    walk as (select face_id, user_id, person_id, 0 as hops from faces union all select w.face_id, w.user_id, a.dst, hops + 1 from walk w join a on a.user_id = w.user_id and a.src = w.person_id)
    select face_id, max_by(person_id, hops) as person_id from walk group by face_id""",
    BASE,
)
def _(t, spark):
    # chains of up to seven merges: 0 -> 5 -> ... -> 35
    alias = t("people").filter("person_id % 50 < 35").selectExpr("user_id", "person_id as src", "person_id + 5 as dst", "created_at as ts")
    return pp.resolve_alias(t("faces"), alias).select("face_id", "person_id")


# each request merges three neighbours into the lowest; every fifth one names a stranger and is rejected
MERGES = "select query_id as request_id, user_id, user_id + 20 * query_id as target, case when query_id % 5 = 4 then -1 else user_id + 20 * query_id + 5 end as s1, user_id + 20 * query_id + 10 as s2 from keyword_queries"


def merge_requests(t):
    q = t("keyword_queries").selectExpr(
        "query_id as request_id", "user_id", "user_id + 20 * query_id as target",
        "array(if(query_id % 5 = 4, -1, user_id + 20 * query_id + 5), user_id + 20 * query_id + 10, user_id + 20 * query_id) as sources",
        "timestamp '2024-05-01 00:00:00' as ts",
    )
    return q


MERGED = f"""m as ({MERGES}), ok as (select * from m where (select count(*) from people p where p.user_id = m.user_id and p.person_id in (m.target, m.s1, m.s2)) = 3),
  al as (select user_id, s1 as src, target as dst from ok union all select user_id, s2, target from ok),
  nf as (select f.user_id, f.face_id, f.file_id, coalesce(al.dst, f.person_id) as person_id, f.score, f.created_at from faces f left join al on al.user_id = f.user_id and al.src = f.person_id)"""


@query(
    "face_merge",
    f"""with {STATS}, {MERGED},
    ih as (select al.user_id, al.dst, min_by(p.name, p.person_id) as name from al join people p on p.user_id = al.user_id and p.person_id = al.src where p.name is not null group by all),
    n2 as (select user_id, person_id, count(*) as n from nf group by all),
    c2 as (select user_id, person_id, face_id from (select *, row_number() over (partition by user_id, person_id order by score desc nulls last, created_at, face_id) as r from nf) x where r = 1)
    select p.person_id, coalesce(p.name, ih.name) as name, case when t.user_id is null then p.face_count else coalesce(n2.n, 0) end as face_count, case when t.user_id is null then p.cover_face_id else c2.face_id end as cover_face_id
    from rp p left join (select distinct user_id, dst from al) t on t.user_id = p.user_id and t.dst = p.person_id left join ih on ih.user_id = p.user_id and ih.dst = p.person_id
      left join n2 on n2.user_id = p.user_id and n2.person_id = p.person_id left join c2 on c2.user_id = p.user_id and c2.person_id = p.person_id
    where not exists (select 1 from al where al.user_id = p.user_id and al.src = p.person_id) and not (t.user_id is not null and coalesce(n2.n, 0) = 0 and coalesce(p.name, ih.name) is null)""".replace(
        "al as (select user_id, s1", "al as (select user_id, s1"
    ).replace("count(*) from people p where", "count(*) from rp p where"),
    ("faces", "people", "keyword_queries"),
)
def _(t, spark):
    _, people, _ = pp.merge_people(t("faces"), refreshed(t), merge_requests(t))
    return people.select("person_id", "name", "face_count", "cover_face_id")


@query(
    "store_faces",
    """with sc as (select user_id, file_id from files where kind in ('photo', 'meme')),
    al as (select user_id, person_id as src, person_id + 5 as dst from people where hidden and exists (select 1 from people q where q.user_id = people.user_id and q.person_id = people.person_id + 5)),
    nw as (select f.user_id, f.face_id + 1000000 as face_id, f.file_id, coalesce(al.dst, f.person_id + case when f.score > 0.9 then 500000 else 0 end) as person_id, f.score from faces f join sc on sc.user_id = f.user_id and sc.file_id = f.file_id
      left join al on al.user_id = f.user_id and al.src = f.person_id + case when f.score > 0.9 then 500000 else 0 end),
    al2 as (select 1),
    af as (select user_id, face_id, file_id, person_id, score from faces f where not exists (select 1 from sc where sc.user_id = f.user_id and sc.file_id = f.file_id) union all select * from nw),
    pe as (select user_id, person_id, name from people union select distinct user_id, person_id, null from nw where not exists (select 1 from people p where p.user_id = nw.user_id and p.person_id = nw.person_id)),
    tc as (select f.user_id, f.person_id from faces f join sc on sc.user_id = f.user_id and sc.file_id = f.file_id union select user_id, person_id from nw)
    select pe.user_id, pe.person_id, pe.name, (select count(*) from af where af.user_id = pe.user_id and af.person_id = pe.person_id) as face_count from pe
    where not (name is null and (select count(*) from af where af.user_id = pe.user_id and af.person_id = pe.person_id) = 0)""",
    ("faces", "people", "files"),
)
def _(t, spark):
    files = t("files")
    scanned = files.filter("kind in ('photo', 'meme')").select("user_id", "file_id")
    found = t("faces").join(scanned, ["user_id", "file_id"], "left_semi").withColumns(
        {"face_id": F.col("face_id") + 1000000, "person_id": F.col("person_id") + F.expr("if(score > 0.9, 500000, 0)")}
    )
    hidden = t("people").filter("hidden").selectExpr("user_id", "person_id as src", "person_id + 5 as dst", "created_at as ts")
    alive = t("people").selectExpr("user_id", "person_id as dst")
    alias = hidden.join(alive, ["user_id", "dst"], "left_semi")
    _, people, _ = pp.store_faces(t("faces"), refreshed(t), files, scanned, found, alias)
    return people.select("user_id", "person_id", "name", "face_count")


# ---------------------------------------------------------------- deletes
GONE = "gone as (select user_id, file_id, file_hash from files where kind = 'receipt')"


@query(
    "delete_cascade",
    f"""with {STATS}, {GONE}, nf as (select * from faces f where not exists (select 1 from gone g where g.user_id = f.user_id and g.file_id = f.file_id)),
    lost as (select distinct f.user_id, f.person_id from faces f join gone g on g.user_id = f.user_id and g.file_id = f.file_id),
    n2 as (select rp.*, (select count(*) from nf where nf.user_id = rp.user_id and nf.person_id = rp.person_id) as n from rp)
    select 'file' as kind, user_id, file_id as id, cast(0 as bigint) as n from files where kind <> 'receipt'
    union all select 'face', user_id, face_id, 0 from nf
    union all select 'person', user_id, person_id, n from n2 where not (n = 0 and name is null and exists (select 1 from lost l where l.user_id = n2.user_id and l.person_id = n2.person_id))""",
    ("faces", "people", "files"),
)
def _(t, spark):
    lib = {"files": t("files"), "faces": t("faces"), "people": refreshed(t)}
    out = pp.delete_files(lib, t("files").filter("kind = 'receipt'").select("user_id", "file_id"))
    zero = F.lit(0).cast("long").alias("n")
    return (
        out["files"].select(F.lit("file").alias("kind"), "user_id", F.col("file_id").alias("id"), zero)
        .unionByName(out["faces"].select(F.lit("face").alias("kind"), "user_id", F.col("face_id").alias("id"), zero))
        .unionByName(out["people"].select(F.lit("person").alias("kind"), "user_id", F.col("person_id").alias("id"), F.col("face_count").alias("n")))
    )


@query(
    "delete_folder",
    """with inside as (select * from files where folder = 'Work' or folder like 'Work/%'), fail as (select user_id, file_id from inside where user_id = 3 and kind = 'meme'),
    gone as (select * from inside i where not exists (select 1 from fail f where f.user_id = i.user_id and f.file_id = i.file_id)),
    paths as (select distinct user_id, provider_id, array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') as path from (select *, unnest(range(1, len(string_split(folder, '/')) + 1)) as i from gone) x where user_id not in (select user_id from fail)),
    freed as (select * from paths p where not exists (select 1 from files f where f.user_id = p.user_id and f.provider_id = p.provider_id and (f.folder = p.path or starts_with(f.folder, p.path || '/')) and not exists (select 1 from gone g where g.user_id = f.user_id and g.file_id = f.file_id)))
    select i.user_id, count(*) - count(f.file_id) as n_files, count(f.file_id) as n_failed, (select count(*) from freed r where r.user_id = i.user_id) as n_folders_removed
    from inside i left join fail f on f.user_id = i.user_id and f.file_id = i.file_id group by i.user_id""",
    ("faces", "people", "files"),
)
def _(t, spark):
    lib = {"files": t("files"), "faces": t("faces"), "people": refreshed(t)}
    failed = t("files").filter("user_id = 3 and kind = 'meme'").select("user_id", "file_id")
    return pp.delete_folder(lib, "Work", failed)[1]


# ---------------------------------------------------------------- clustering
@query("face_cluster")
def _(t, spark):
    """Every face is assigned: those of the scored ones are known, the unscored and rescanned ones are new."""
    faces = t("faces").withColumn("file_seq", F.col("file_id") + 1)
    known = faces.filter("score < 0.3").withColumn("person_id", F.col("person_id").cast("string"))
    new = faces.filter("score >= 0.3 or score is null").drop("person_id")
    out = fc.assign_faces(new, known, threshold=0.2)
    return cut_lineage(out.select("user_id", "file_id", "face_id", "person_id"))


@query(
    "bbox_normalize",
    """with d as (select event_id as det_id, user_id, event_id % 400 as file_id, value - 20.0013 as x, (event_id % 97) * 8.537 - 20.003 as y, 10.0007 + value as w, 12 + (event_id % 131) * 6.0071 as h, value / 577.31 as score,
      1280.0 as image_width, 960.0 as image_height, 0.5 + (event_id % 6) / 10.0 as scale from events),
    k as (select *, round(score, 3) as s from d where least(w, h) >= 24 * scale), r as (select *, row_number() over (partition by user_id, file_id order by s desc, det_id) as n from k)
    select det_id, s as score, round(greatest(0.0, x / image_width), 4) as bx, round(greatest(0.0, y / image_height), 4) as by_, round(least(1.0, w / image_width), 4) as bw, round(least(1.0, h / image_height), 4) as bh from r where n <= 20""",
)
def _(t, spark):
    det = t("events").selectExpr(
        "event_id as det_id", "user_id", "event_id % 400 as file_id", "value - 20.0013D as x", "(event_id % 97) * 8.537D - 20.003D as y", "10.0007D + value as w", "12 + (event_id % 131) * 6.0071D as h",
        "value / 577.31D as score", "1280.0D as image_width", "960.0D as image_height", "0.5D + (event_id % 6) / 10.0D as scale",
    )
    b = F.col("bbox")
    return fc.normalize_faces(det).select("det_id", "score", b[0].alias("bx"), b[1].alias("by_"), b[2].alias("bw"), b[3].alias("bh"))
