"""Library queries: predicates, joins by key, facets, pages, filters, keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.operators import ingest as ig
from mediashelf.operators import library as lb
from mediashelf.operators.documents import search_text
from mediashelf.sources import sinks, uploads

from . import query

VISIBLE = "status <> 'failed' and provider_file_id is not null"
EVENT_TIME = "coalesce(taken_at, created_at)"


# ---------------------------------------------------------------- predicates
@query("filter_visible", f"select file_id, status from files where {VISIBLE}", ("files",))
def _(t, spark):
    return lb.visible(t("files")).select("file_id", "status")


@query("filter_tag", "select file_id from files where list_contains(tags, 'snow')", ("files",))
def _(t, spark):
    return lb.has_tag(t("files"), "snow").select("file_id")


@query("filter_folder_subtree", r"select file_id, folder from files where folder = 'Work/50%' or folder like 'Work/50\%/%' escape '\'", ("files",))
def _(t, spark):
    return lb.in_folder(t("files"), "Work/50%").select("file_id", "folder")


@query(
    "filter_place_ilike",
    "select file_id from files where place_area ilike 'MUMBAI' or place_city ilike 'MUMBAI' or place_region ilike 'MUMBAI' or place_country ilike 'MUMBAI' or place_area ilike 'alfama' or place_city ilike 'alfama' or place_region ilike 'alfama' or place_country ilike 'alfama'",
    ("files",),
)
def _(t, spark):
    wanted = F.array(F.lit("mumbai"), F.lit("alfama"))
    places = F.array_compact(F.array(*[F.lower(c) for c in lb.PLACE_COLUMNS]))
    return t("files").filter(F.arrays_overlap(places, wanted)).select("file_id")


@query(
    "filter_model_stale",
    f"""select user_id, file_id, 'embed' as work_kind from files where {VISIBLE} and media_type = 'image' and embed_model is distinct from 'm1'
    union all select user_id, file_id, 'faces' from files where {VISIBLE} and media_type = 'image' and not faces_scanned
    union all select user_id, file_id, 'docindex' from files where {VISIBLE} and media_type = 'document' and title is null""",
    ("files",),
)
def _(t, spark):
    return lb.select_for_reindex(t("files"), "m1")


CARD_PEOPLE = """with fp as (select f.user_id, f.file_id, string_agg(concat(p.person_id, ':', coalesce(p.name, '')), ';' order by p.name nulls last, p.person_id) as people
  from faces f join people p on f.user_id = p.user_id and f.person_id = p.person_id where not p.hidden group by all)"""


def _people_text(c):
    return F.array_join(F.transform(c, lambda p: F.concat(p["id"].cast("string"), F.lit(":"), F.coalesce(p["name"], F.lit("")))), ";")


@query(
    "project_file_card",
    f"""{CARD_PEOPLE}
    select f.file_id as id, f.user_id, split('gdrive,dropbox,,koofr,pcloud', ',')[provider_id] as provider, nullif(folder, '') as folder, coalesce(people, '') as people,
      provider_file_id is not null and status <> 'failed' as viewable, provider_file_id is not null and status <> 'failed' and media_type <> 'document' as has_thumb,
      array_to_string(tags, ',') as tags, place_name as place, title
    from files f left join fp on fp.user_id = f.user_id and fp.file_id = f.file_id""",
    ("files", "faces", "people"),
)
def _(t, spark):
    cards = lb.file_cards(t("files"), t("faces"), t("people"))
    return cards.select("id", "user_id", "provider", "folder", _people_text(F.col("people")).alias("people"), "viewable", "has_thumb", F.array_join("tags", ",").alias("tags"), "place", "title")


@query("agg_people_json", f"{CARD_PEOPLE} select f.file_id, coalesce(people, '') as people from files f left join fp on fp.user_id = f.user_id and fp.file_id = f.file_id", ("files", "faces", "people"))
def _(t, spark):
    per_file = lb.people_per_file(t("faces"), t("people"))
    df = t("files").select("user_id", "file_id").join(per_file, ["user_id", "file_id"], "left")
    return df.select("file_id", F.coalesce(_people_text(F.col("people")), F.lit("")).alias("people"))


from .scalars import DATE_WORDS_SQL, NOISE  # noqa: E402


@query(
    "project_search_text",
    rf"""with w as (select *, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(name, '(?i)\.[a-z0-9]{{2,5}}$', ''), '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z]+'), lambda x: lower(x)), lambda x: length(x) > 2 and x not in ({NOISE})) as fw,
      taken_at as ts from files),
    d as (select *, string_split({DATE_WORDS_SQL}, ' ') as dw from w),
    p as (select file_id, list_filter(list_concat([kind], tags, fw, dw,
      [case when width > 0 and abs(width - height) < 0.05 * greatest(width, height) then 'square' when height > width then 'portrait vertical' else 'landscape horizontal' end],
      [lower(camera)], [lower(place_area), lower(place_city), lower(place_region), lower(place_country)], [case when lat is not null then 'geotagged location' end]), lambda x: x is not null and x <> '') as parts from d)
    select file_id, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ' ') as search_text from p""",
    ("files",),
)
def _(t, spark):
    c = F.col
    text = search_text(c("kind"), c("tags"), c("name"), c("taken_at"), c("width"), c("height"), c("camera"), [c(p) for p in lb.PLACE_COLUMNS], c("lat"))
    return t("files").select("file_id", text.alias("search_text"))


# ---------------------------------------------------------------- structured filters
def filter_queries(t):
    """Filters derived from the keyword queries: every combination of fields occurs, and queries without any."""
    return t("keyword_queries").selectExpr(
        "query_id",
        "user_id",
        "case when query_id % 4 = 1 then date '2023-06-01' + cast(query_id % 90 as int) end as date_from",
        "case when query_id % 8 in (1, 2) then date '2024-05-01' + cast(query_id % 50 as int) end as date_to",
        "case when query_id % 5 = 2 then array(5, cast(1 + query_id % 12 as int)) else cast(array() as array<int>) end as months",
        "case when query_id % 7 = 3 then array('photo', 'chart', 'meme') else cast(array() as array<string>) end as kinds",
        "case when query_id % 6 = 4 then array('GOA', 'portugal') else cast(array() as array<string>) end as places",
        "case when query_id % 10 = 6 then array(user_id + 5, user_id + 5, user_id + 20) when query_id % 10 = 8 then array(user_id + 10) else cast(array() as array<bigint>) end as person_ids",
    )


FILTER_QUERIES = """fq as (select query_id, user_id,
    case when query_id % 4 = 1 then date '2023-06-01' + cast(query_id % 90 as int) end as date_from,
    case when query_id % 8 in (1, 2) then date '2024-05-01' + cast(query_id % 50 as int) end as date_to,
    case when query_id % 5 = 2 then [5, 1 + query_id % 12] else [] end as months,
    case when query_id % 7 = 3 then ['photo', 'chart', 'meme'] else [] end as kinds,
    case when query_id % 6 = 4 then ['GOA', 'portugal'] else [] end as places,
    case when query_id % 10 = 6 then [user_id + 5, user_id + 5, user_id + 20] when query_id % 10 = 8 then [user_id + 10] else [] end as person_ids from keyword_queries),
  allow as (select q.query_id, f.file_hash, f.user_id, coalesce(f.taken_at, f.created_at) as event_time from fq q join files f on f.user_id = q.user_id
    where f.status <> 'failed' and f.provider_file_id is not null
      and (date_from is not null or date_to is not null or len(months) > 0 or len(kinds) > 0 or len(places) > 0 or len(person_ids) > 0)
      and (date_from is null or coalesce(taken_at, created_at) >= date_from) and (date_to is null or coalesce(taken_at, created_at) < date_to + 1)
      and (len(months) = 0 or list_contains(months, month(coalesce(taken_at, created_at)))) and (len(kinds) = 0 or list_contains(kinds, kind))
      and (len(places) = 0 or len(list_filter(places, lambda p: coalesce(place_area ilike p, false) or coalesce(place_city ilike p, false) or coalesce(place_region ilike p, false) or coalesce(place_country ilike p, false))) > 0)
      and (len(person_ids) = 0 or len(list_distinct(person_ids)) = (select count(distinct person_id) from faces x where x.user_id = f.user_id and x.file_id = f.file_id and list_contains(person_ids, x.person_id))))"""


@query("filter_structured", f"with {FILTER_QUERIES} select query_id, file_hash, event_time from allow", ("files", "faces", "keyword_queries"))
def _(t, spark):
    return lb.resolve_filters(filter_queries(t), t("files"), t("faces")).select("query_id", "file_hash", "event_time")


@query(
    "filter_all_people",
    """with q as (select query_id, user_id, [user_id + 5, user_id + 20, user_id + 5] as ids from keyword_queries)
    select query_id, f.file_id from q join faces f on f.user_id = q.user_id where list_contains(ids, person_id) group by query_id, f.file_id having count(distinct person_id) = 2""",
    ("faces", "keyword_queries"),
)
def _(t, spark):
    q = t("keyword_queries").withColumn("person_ids", F.array(F.col("user_id") + 5, F.col("user_id") + 20, F.col("user_id") + 5))
    return lb.with_all_people(t("faces"), q).select("query_id", "file_id")


@query("semi_person", "select file_id from files f where exists (select 1 from faces x where x.user_id = f.user_id and x.file_id = f.file_id and x.person_id = 33)", ("files", "faces"))
def _(t, spark):
    return lb.with_person(t("files"), t("faces"), 33).select("file_id")


@query(
    "join_allow_list",
    f"""with {FILTER_QUERIES}, cand as (select q.query_id, f.file_hash from keyword_queries q join files f on f.user_id = q.user_id and f.file_id % 11 = q.query_id % 11),
    lim as (select query_id from fq where date_from is not null or date_to is not null or len(months) > 0 or len(kinds) > 0 or len(places) > 0 or len(person_ids) > 0)
    select c.query_id, c.file_hash from cand c where c.query_id not in (select query_id from lim) or exists (select 1 from allow a where a.query_id = c.query_id and a.file_hash = c.file_hash)""",
    ("files", "faces", "keyword_queries"),
)
def _(t, spark):
    q = filter_queries(t)
    q = q.withColumn("filtered", lb.has_filters(q))
    files = t("files").withColumn("slot", F.col("file_id") % 11)
    cand = q.withColumn("slot", F.col("query_id") % 11).join(files, ["user_id", "slot"]).select("query_id", "file_hash")
    return lb.within(cand, q, lb.resolve_filters(q, t("files"), t("faces")))


@query(
    "sort_newest_first",
    f"with {FILTER_QUERIES} select query_id, file_hash, event_time, position from (select *, row_number() over (partition by query_id order by event_time desc, file_hash) as position from allow) r where position <= 5",
    ("files", "faces", "keyword_queries"),
)
def _(t, spark):
    allow = lb.resolve_filters(filter_queries(t), t("files"), t("faces"))
    out = lb.newest(allow.drop("event_time"), t("files"), 5)
    return out.select("query_id", "file_hash", "event_time", F.col("position").cast("long").alias("position"))


# ---------------------------------------------------------------- joins by key
@query("join_files_by_hash", "select u.upload_id as rank, f.file_id, f.file_hash from uploads u join files f on u.user_id = f.user_id and u.file_hash = f.file_hash", ("uploads", "files"))
def _(t, spark):
    hits = t("uploads").select("user_id", "file_hash", F.col("upload_id").alias("rank"))
    return lb.hydrate(hits, t("files")).select("rank", "file_id", "file_hash")


@query("join_lookup_file", "select file_id, status from files f where exists (select 1 from uploads u where u.user_id = f.user_id and u.file_hash = f.file_hash and u.lang = 'fr')", ("uploads", "files"))
def _(t, spark):
    keys = t("uploads").filter("lang = 'fr'").select("user_id", "file_hash")
    return lb.lookup_files(keys, t("files")).select("file_id", "status")


@query(
    "join_provider_status",
    """with u as (select distinct user_id from files), p as (select unnest([1, 2, 4, 5]) as provider_id, unnest(['gdrive', 'dropbox', 'koofr', 'pcloud']) as provider)
    select u.user_id, p.provider, exists (select 1 from quota q where q.user_id = u.user_id and q.provider_id = p.provider_id and q.used > 9000) as connected from u cross join p""",
    ("files", "quota"),
)
def _(t, spark):
    return lb.provider_status(t("files"), t("quota").filter("used > 9000")).select("user_id", "provider", "connected")


# ---------------------------------------------------------------- facets and pages
@query(
    "agg_top_tags",
    """select user_id, tag, n_files from (select user_id, tag, n_files, row_number() over (partition by user_id order by n_files desc, tag) as r
    from (select user_id, tag, count(*) as n_files from (select user_id, unnest(tags) as tag from files where status <> 'failed') x group by all) y) z where r <= 6""",
    ("files",),
)
def _(t, spark):
    return lb.top_tags(t("files"), 6)


@query(
    "agg_top_folders",
    f"""select user_id, folder, n_files from (select *, row_number() over (partition by user_id order by n_files desc, folder) as r
    from (select user_id, split_part(folder, '/', 1) as folder, count(*) as n_files from files where folder <> '' and {VISIBLE} group by 1, 2) y) z where r <= 24""",
    ("files",),
)
def _(t, spark):
    return lb.top_folders(t("files"))


@query("agg_known_places", "select distinct user_id, place from (select user_id, unnest([place_area, place_city, place_region, place_country]) as place from files where place_name is not null) x where place is not null", ("files",))
def _(t, spark):
    return lb.known_places(t("files"))


@query(
    "page_keyset",
    f"""with v as (select * from files where user_id = 2 and {VISIBLE} and list_contains(tags, 'dog') or user_id = 2 and {VISIBLE} and list_contains(tags, 'blue')),
    c as (select *, row_number() over (order by created_at desc, file_id desc) as n from v), a as (select created_at, file_id from c where n = 10),
    p as (select v.* from v, a where (v.created_at, v.file_id) < (a.created_at, a.file_id)), r as (select *, row_number() over (order by created_at desc, file_id desc) as n, count(*) over () as total from p)
    select file_id, created_at, case when n = 7 and total > 7 then rtrim(translate(base64(encode(concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g'), 'Z|', file_id))), '+/', '-_'), '=') end as next_cursor from r where n <= 7""",
    ("files",),
)
def _(t, spark):
    mine = t("files").filter("user_id = 2 and (array_contains(tags, 'dog') or array_contains(tags, 'blue'))")
    first = lb.list_files(mine, limit=10).filter("next_cursor is not null").head()
    return lb.list_files(mine, limit=7, cursor=first.next_cursor).select("file_id", "created_at", "next_cursor")


@query(
    "agg_storage_quota",
    """select cast(user_id as bigint) as user_id, cast(provider_id as bigint) as provider_id, round(sum(case when not failing then total end), 2) as total, round(sum(case when not failing then used end), 2) as used,
      round(sum(case when not failing then greatest(0.0, total - used) end), 2) as free, count(case when failing then 1 end) as n_failing, provider_id is null as is_overall
    from quota group by grouping sets ((user_id, provider_id), (user_id))""",
    ("quota",),
)
def _(t, spark):
    df = lb.storage_rollup(t("quota"))
    money = {c: F.round(c, 2) for c in ("total", "used", "free")}
    return df.withColumns(money | {c: F.col(c).cast("long") for c in ("user_id", "provider_id")})


# ---------------------------------------------------------------- scans and keyed writes
@query(
    "scan_manifest",
    """with e as (select *, regexp_extract(lower(name), '^.+(\\.[^./]*)$', 1) as ext, coalesce(regexp_matches(mime, '^image/(jpeg|png|gif|webp|bmp|heic|heif|avif|tiff)$'), false) as img from uploads),
    m as (select *, case when img then 'image' when ext in ('.pdf', '.docx', '.txt', '.md') then 'document' end as media_type from e)
    select upload_id, media_type, case when media_type = 'document' then case ext when '.pdf' then 'application/pdf' when '.txt' then 'text/plain' when '.md' then 'text/markdown' else 'docx' end else mime end as mime,
      case when media_type is null then 'unsupported type' when size > 50 * 1048576 then 'files are limited to 50 MB' when media_type = 'image' and size > 25 * 1048576 then 'images are limited to 25 MB' end as reject from m""",
    ("uploads",),
)
def _(t, spark):
    return uploads.classify_uploads(t("uploads")).select("upload_id", "media_type", "mime", "reject")


UPDATES = "select user_id, file_hash, upload_id, concat('new_', name) as name, size + 1 as size, 'indexing' as status, ts from uploads where lang <> 'en'"


@query(
    "sink_upsert_files",
    f"""with u as (select * from (select *, row_number() over (partition by user_id, file_hash order by ts desc, upload_id desc) as r from ({UPDATES}) x) y where r = 1),
    b as (select * from files where status <> 'indexing')
    select coalesce(b.user_id, u.user_id) as user_id, coalesce(b.file_hash, u.file_hash) as file_hash, case when u.user_id is null then b.name else u.name end as name,
      case when u.user_id is null then b.size else u.size end as size, case when u.user_id is null then b.status else u.status end as status, b.kind
    from b full outer join u on b.user_id = u.user_id and b.file_hash = u.file_hash""",
    ("uploads", "files"),
)
def _(t, spark):
    base = t("files").filter("status <> 'indexing'").select("user_id", "file_hash", "name", "size", "status", "kind")
    new = t("uploads").filter("lang <> 'en'").selectExpr("user_id", "file_hash", "upload_id", "concat('new_', name) as name", "size + 1 as size", "'indexing' as status", "ts")
    return sinks.upsert(base, new, ["user_id", "file_hash"], [F.desc("ts"), F.desc("upload_id")])


@query("win_latest_upsert", "select user_id, file_hash, upload_id from (select *, row_number() over (partition by user_id, file_hash order by ts desc, upload_id desc) as r from uploads) x where r = 1", ("uploads",))
def _(t, spark):
    return sinks.latest(t("uploads"), ["user_id", "file_hash"], [F.desc("ts"), F.desc("upload_id")]).select("user_id", "file_hash", "upload_id")


@query(
    "sink_upsert_vectors",
    """with n as (select user_id, embed_model, file_hash, label + 1000 as label from image_index where kind = 'photo')
    select user_id, embed_model, file_hash, label, sha256(concat(cast(user_id as string), ':', file_hash)) as object_id from
    (select user_id, embed_model, file_hash, label from image_index i where kind <> 'meme' and not exists (select 1 from n where n.user_id = i.user_id and n.embed_model = i.embed_model and n.file_hash = i.file_hash) union all select * from n) x""",
    ("image_index",),
)
def _(t, spark):
    i = t("image_index")
    base = i.filter("kind <> 'meme'").select("user_id", "embed_model", "file_hash", "label", "embedding")
    new = i.filter("kind = 'photo'").withColumn("label", F.col("label") + 1000)
    return sinks.upsert_image_index(base, new, [F.desc("vec_id")]).select("user_id", "embed_model", "file_hash", "label", "object_id")


@query(
    "partial_update",
    """select f.file_id, case when status = 'indexing' then 'ready' else status end as status, case when status = 'indexing' then null else title end as title,
      case when status = 'indexing' and media_type = 'document' then 77 else page_count end as page_count from files f""",
    ("files",),
)
def _(t, spark):
    files = t("files").select("file_id", "status", "title", "page_count", "media_type")
    patches = files.filter("status = 'indexing'").selectExpr(
        "file_id",
        "if(media_type = 'document', array('status', 'title', 'page_count'), array('status', 'title')) as fields",
        "'ready' as status", "cast(null as string) as title", "77 as page_count",
    )
    return sinks.apply_patch(files, patches, ["file_id"]).drop("media_type")


@query("set_enqueue_once", "select user_id, file_hash, min(upload_id) as upload_id from uploads group by all", ("uploads",))
def _(t, spark):
    return ig.once_per_flow(t("uploads").select("user_id", "file_hash", "upload_id", "name")).select("user_id", "file_hash", "upload_id")


@query(
    "set_client_dedupe",
    """with l as (select user_id, folder, name, size, case when lang = 'de' then 'error' else 'done' end as status from uploads where mime like 'image/%')
    select upload_id from uploads u where not exists (select 1 from l where l.status <> 'error' and l.user_id = u.user_id and l.folder = u.folder and l.name = u.name and l.size = u.size)""",
    ("uploads",),
)
def _(t, spark):
    listed = t("uploads").filter("mime like 'image/%'").selectExpr("user_id", "folder", "name", "size", "if(lang = 'de', 'error', 'done') as status")
    return ig.unlisted(t("uploads"), listed).select("upload_id")


@query(
    "anti_new_uploads",
    "select upload_id from uploads u where not exists (select 1 from files f where f.user_id = u.user_id and f.file_hash = u.file_hash and f.status <> 'failed')",
    ("uploads", "files"),
)
def _(t, spark):
    return ig.new_uploads(t("uploads"), t("files")).select("upload_id")
