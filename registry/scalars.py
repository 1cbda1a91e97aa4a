"""Column functions over whole tables: strings, dates, vectors, geography, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.functions import dates as dt
from mediashelf.functions import fixed_values as fv
from mediashelf.functions import geo, vectors
from mediashelf.functions import text as tx
from mediashelf.operators import ingest as ig
from mediashelf.operators import people as pp

from . import query

WS = r"[\s\p{Z}]+"
NOISE = ", ".join(f"'{w}'" for w in fv.FILENAME_NOISE)
STOP = ", ".join(f"'{w}'" for w in fv.COVERAGE_STOP_WORDS)


# ---------------------------------------------------------------- strings
@query(
    "str_clean_name",
    r"""select upload_id, substring(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text),
      '[\x00-\x1f\\/:*?"<>|]', '_', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^\.+$', ''), 1, 120) as clean from uploads""",
    ("uploads",),
)
def _(t, spark):
    return t("uploads").select("upload_id", tx.clean_name(F.col("text")).alias("clean"))


@query(
    "str_folder_path",
    r"""select upload_id, array_to_string(list_slice(list_filter(list_transform(
      string_split_regex(folder, '[\\/]+'), lambda x: substring(regexp_replace(trim(regexp_replace(x, '[\x00-\x1f\\/:*?"<>|]', '_', 'g')), '^\.+$', ''), 1, 120)),
      lambda x: x <> ''), 1, 10), '/') as clean from uploads""",
    ("uploads",),
)
def _(t, spark):
    return t("uploads").select("upload_id", tx.folder_path(F.col("folder")).alias("clean"))


@query(
    "str_cloud_name",
    r"""with c as (select *, regexp_replace(name, '[\x00-\x1f\\/:*?"<>|]', '_', 'g') as clean from uploads),
    f as (select *, min(upload_id) over (partition by user_id, folder, clean) as first_id from c)
    select upload_id, case when upload_id = first_id then clean
      else concat(regexp_replace(clean, '^(.+)\.[^.]*$', '\1'), ' (', substring(file_hash, 1, 8), ')', regexp_extract(clean, '^.+(\.[^.]*)$', 1)) end as cloud_name from f""",
    ("uploads",),
)
def _(t, spark):
    return ig.cloud_names(t("uploads").select("upload_id", "user_id", "folder", "name", "file_hash")).select("upload_id", "cloud_name")


@query(
    "str_filename_words",
    rf"""select upload_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(
      regexp_replace(name, '(?i)\.[a-z0-9]{{2,5}}$', ''), '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z]+'), lambda x: lower(x)),
      lambda x: length(x) > 2 and x not in ({NOISE})), ' ') as words from uploads""",
    ("uploads",),
)
def _(t, spark):
    return t("uploads").select("upload_id", F.array_join(tx.filename_words(F.col("name")), " ").alias("words"))


CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '-\n([\p{L}\p{N}_])', '\1', 'g'),
      '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"""


@query("str_clean_text", f"select upload_id, sha256({CLEAN_SQL}) as clean_hash, length({CLEAN_SQL}) as n from uploads", ("uploads",))
def _(t, spark):
    df = t("uploads").select("upload_id", tx.clean_text(F.col("text")).alias("c"))
    return df.select("upload_id", F.sha2("c", 256).alias("clean_hash"), F.length("c").cast("long").alias("n"))


@query(
    "str_doc_title",
    r"""with n as (select upload_id, concat('# ', substring(text, 1, 60), chr(10), text) as body, name from uploads),
    x as (select upload_id, case when regexp_matches(lower(name), '\.(md|markdown)$') then nullif(trim(regexp_extract(body, '(?m)^#\s+(.+)$', 1)), '') end as heading,
      nullif(trim(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[_-]+', ' ', 'g')), '') as readable from n)
    select upload_id, substring(coalesce(heading, readable, 'Untitled'), 1, 300) as title from x""",
    ("uploads",),
)
def _(t, spark):
    body = F.concat(F.lit("# "), F.substring("text", 1, 60), F.lit("\n"), F.col("text"))
    return t("uploads").select("upload_id", tx.doc_title(body, F.col("name")).alias("title"))


@query(
    "str_excerpt",
    r"""select upload_id, substring(regexp_replace(regexp_replace(regexp_replace(text, '[#*_`>]+', '', 'g'), '[\s\p{Z}]+', ' ', 'g'),
      '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 1, 400) as excerpt from uploads""",
    ("uploads",),
)
def _(t, spark):
    return t("uploads").select("upload_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query(
    "str_chunk",
    r"""with w as (select doc_id, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '') as ws from documents),
    r as (select doc_id, ws, unnest(range(0, greatest(0, cast(ceil((len(ws) - 300) / 250.0) as bigint)) + 1)) as i from w where len(ws) > 0)
    select doc_id, i as chunk, sha256(array_to_string(list_slice(ws, i * 250 + 1, i * 250 + 300), ' ')) as text_hash from r""",
)
def _(t, spark):
    df = t("documents").select("doc_id", tx.split_words(F.col("text")).alias("ws"))
    rows = df.select("doc_id", F.posexplode(tx.chunk_words(F.col("ws"))).alias("chunk", "piece"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2("piece", 256).alias("text_hash"))


@query(
    "str_snippet",
    r"""with q as (select doc_id, text, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '') as ws,
      list_filter(list_distinct(string_split_regex(lower(right(text, 30)), '[^\p{L}\p{N}_]+')), lambda x: length(x) > 2) as terms from documents),
    h as (select *, greatest(0, coalesce(list_position(list_transform(ws, lambda w: len(list_filter(terms, lambda x: contains(lower(w), x))) > 0), true), 0) - 1 - 13) as s from q)
    select doc_id, concat(case when s > 0 then '… ' else '' end, array_to_string(list_slice(ws, s + 1, s + 40), ' '),
      case when s + 40 < len(ws) then ' …' else '' end) as snippet from h""",
)
def _(t, spark):
    return t("documents").select("doc_id", tx.snippet(F.col("text"), F.right("text", F.lit(30))).alias("snippet"))


COVERAGE_SQL = rf"""with b as (select item_id, list_filter(list_distinct(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+')), lambda x: length(x) > 2 and x not in ({STOP})) as terms from benchmark),
    d as (select doc_id, list_distinct(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+')) as ws from documents),
    n as (select count(*) as n from benchmark)
    select doc_id, item_id, round(case when len(terms) = 0 then 1.0 else len(list_intersect(terms, ws)) / len(terms) end, 9) as coverage
    from d join b on b.item_id = d.doc_id % (select n from n)"""


@query("str_term_coverage", COVERAGE_SQL)
def _(t, spark):
    b = t("benchmark").select("item_id", F.col("text").alias("q"))
    d = t("documents").withColumn("item_id", F.col("doc_id") % b.count())
    return d.join(b, "item_id").select("doc_id", "item_id", F.round(tx.term_coverage(F.col("q"), F.col("text")), 9).alias("coverage"))


@query(
    "str_slug_model",
    r"select upload_id, concat('Img_', trim(regexp_replace(concat('Model-', name, '/', mime, '!'), '[^A-Za-z0-9]+', '_', 'g'), '_')) as slug from uploads",
    ("uploads",),
)
def _(t, spark):
    model = F.concat(F.lit("Model-"), "name", F.lit("/"), "mime", F.lit("!"))
    return t("uploads").select("upload_id", tx.model_slug(model).alias("slug"))


@query(
    "str_escape_like",
    r"select upload_id, regexp_replace(concat(folder, '_', name), '([\\%_])', '\\\1', 'g') as escaped from uploads",
    ("uploads",),
)
def _(t, spark):
    return t("uploads").select("upload_id", tx.escape_like(F.concat("folder", F.lit("_"), "name")).alias("escaped"))


@query(
    "str_format_bytes",
    """with s as (select upload_id, cast(size as double) * (case when upload_id % 3 = 0 then 1 when upload_id % 3 = 1 then 977 else 90001 end) * (upload_id % 11) as b from uploads),
    e as (select upload_id, b, least(4, cast(floor(ln(b) / ln(1024.0)) as int)) as i from s where b > 0)
    select upload_id, printf(case when i >= 3 then '%.1f %s' else '%.0f %s' end, b / pow(1024.0, i), ['B', 'KB', 'MB', 'GB', 'TB'][i + 1]) as shown from e
    union all select upload_id, '0 B' from s where b <= 0""",
    ("uploads",),
)
def _(t, spark):
    third = F.col("upload_id") % 3
    factor = F.when(third == 0, 1).when(third == 1, 977).otherwise(90001)
    return t("uploads").select("upload_id", tx.format_bytes(F.col("size").cast("double") * factor * (F.col("upload_id") % 11)).alias("shown"))


@query(
    "str_ancestors",
    """with p as (select file_id, string_split(folder, '/') as parts from files)
    select file_id, array_to_string(list_slice(parts, 1, i), '/') as path from (select file_id, parts, unnest(range(1, len(parts) + 1)) as i from p) x""",
    ("files",),
)
def _(t, spark):
    return t("files").select("file_id", F.explode(tx.ancestors(F.col("folder"))).alias("path"))


@query("str_content_hash", "select doc_id, sha256(text) as file_hash from documents")
def _(t, spark):
    return t("documents").select("doc_id", tx.content_hash(F.col("text")).alias("file_hash"))


@query(
    "str_camera",
    r"""with c as (select p_partkey, case when p_partkey % 5 = 0 then '' when p_partkey % 5 = 1 then 'Canon Inc.' when p_partkey % 5 = 2 then 'NIKON' when p_partkey % 5 = 3 then null else ' Apple ' end as mk,
      concat(case when p_partkey % 3 = 0 then 'Canon EOS ' when p_partkey % 3 = 1 then 'iPhone ' else '' end, case when p_partkey % 7 = 0 then '' else cast(p_partkey % 90 as string) end) as md from part),
    s as (select p_partkey, trim(coalesce(mk, '')) as mk, trim(md) as md from c)
    select p_partkey, nullif(case when mk <> '' and starts_with(lower(md), lower(regexp_extract(mk, '^\S+'))) then md else trim(concat(mk, ' ', md)) end, '') as camera from s""",
)
def _(t, spark):
    df = t("part").selectExpr(
        "p_partkey",
        """case when p_partkey % 5 = 0 then '' when p_partkey % 5 = 1 then 'Canon Inc.' when p_partkey % 5 = 2 then 'NIKON'
           when p_partkey % 5 = 3 then null else ' Apple ' end as mk""",
        """concat(case when p_partkey % 3 = 0 then 'Canon EOS ' when p_partkey % 3 = 1 then 'iPhone ' else '' end,
           case when p_partkey % 7 = 0 then '' else cast(p_partkey % 90 as string) end) as md""",
    )
    return df.select("p_partkey", tx.camera(F.col("mk"), F.col("md")).alias("camera"))


@query(
    "filter_validate_hash",
    "select doc_id, regexp_full_match(case when doc_id % 4 = 0 then upper(sha256(text)) when doc_id % 4 = 1 then substring(sha256(text), 2) else sha256(text) end, '[0-9a-f]{64}') as ok from documents",
)
def _(t, spark):
    h = F.expr("case when doc_id % 4 = 0 then upper(sha2(text, 256)) when doc_id % 4 = 1 then substring(sha2(text, 256), 2) else sha2(text, 256) end")
    return t("documents").select("doc_id", tx.valid_hash(h).alias("ok"))


# ---------------------------------------------------------------- dates
EXIF = """case when upload_id % 5 = 0 then date_format(ts, 'yyyy:MM:dd HH:mm:ss') when upload_id % 5 = 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss')
  when upload_id % 5 = 2 then concat(date_format(ts, 'yyyy:MM:dd'), ' tail') when upload_id % 5 = 3 then 'not a date' else '2024:02:31 10:00:00' end"""
EXIF_SQL = """case when upload_id % 5 = 0 then strftime(ts, '%Y:%m:%d %H:%M:%S') when upload_id % 5 = 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when upload_id % 5 = 2 then strftime(ts, '%Y:%m:%d') || ' tail' when upload_id % 5 = 3 then 'not a date' else '2024:02:31 10:00:00' end"""
PARSE_SQL = """coalesce(try_strptime(substring(v, 1, 19), '%Y:%m:%d %H:%M:%S'), try_strptime(substring(v, 1, 19), '%Y-%m-%d %H:%M:%S'), try_strptime(substring(v, 1, 10), '%Y:%m:%d'))"""
NAME_DATE_SQL = rf"""try_strptime(concat_ws('-', regexp_extract(name, '{fv.FILENAME_DATE}', 1), regexp_extract(name, '{fv.FILENAME_DATE}', 2), regexp_extract(name, '{fv.FILENAME_DATE}', 3)), '%Y-%m-%d')"""


@query("dt_parse_exif", f"with e as (select upload_id, {EXIF_SQL} as v from uploads) select upload_id, {PARSE_SQL} as parsed from e", ("uploads",))
def _(t, spark):
    return t("uploads").select("upload_id", dt.parse_exif_ts(F.expr(EXIF)).alias("parsed"))


@query("dt_from_filename", f"select upload_id, {NAME_DATE_SQL} as named from uploads", ("uploads",))
def _(t, spark):
    return t("uploads").select("upload_id", dt.date_from_name(F.col("name")).alias("named"))


@query(
    "dt_taken_at",
    f"with e as (select upload_id, name, case when upload_id % 3 = 0 then null else {EXIF_SQL} end as v from uploads) select upload_id, coalesce({PARSE_SQL}, {NAME_DATE_SQL}) as taken from e",
    ("uploads",),
)
def _(t, spark):
    original = F.when(F.col("upload_id") % 2 == 0, F.expr(f"case when upload_id % 3 = 0 then null else {EXIF} end"))
    modified = F.expr(f"case when upload_id % 3 = 0 then null else {EXIF} end")
    return t("uploads").select("upload_id", dt.taken_at(original, modified, F.col("name")).alias("taken"))


HOLIDAYS_SQL = " ".join(f"when strftime(ts, '%m-%d') = '{d}' then '{w.replace(chr(39), chr(39) * 2)} '" for d, w in fv.HOLIDAY_WORDS.items())
DATE_WORDS_SQL = f"""case when ts is null then '' else trim(concat(year(ts), ' ', lower(strftime(ts, '%B')), ' ', lower(strftime(ts, '%b')), ' ', lower(strftime(ts, '%A')), ' ',
  case when month(ts) in (3, 4, 5) then 'spring' when month(ts) in (6, 7, 8) then 'summer' when month(ts) in (9, 10, 11) then 'autumn' else 'winter' end, ' ',
  strftime(ts, '%Y-%m'), ' ', case when isodow(ts) >= 6 then 'weekend ' else '' end, case {HOLIDAYS_SQL} else '' end,
  case when hour(ts) = 0 and minute(ts) = 0 then '' when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 16 then 'afternoon'
    when hour(ts) between 17 and 20 then 'evening' else 'night' end)) end"""


@query("dt_words", f"select event_id, {DATE_WORDS_SQL} as words from (select event_id, case when event_id % 50 = 0 then null else ts + interval '1' day * cast(event_id % 365 as int) end as ts from events) e")
def _(t, spark):
    ts = F.expr("case when event_id % 50 = 0 then null else cast(ts as timestamp) + interval '1' day * cast(event_id % 365 as int) end")
    df = t("events").select("event_id", ts.alias("ts"))
    return df.select("event_id", F.array_join(dt.date_words(F.col("ts")), " ").alias("words"))


@query(
    "dt_season_range",
    """with s as (select o_orderkey, split('spring,summer,autumn,fall,winter', ',')[o_orderkey % 5 + 1] as season, cast(1990 + o_orderkey % 60 as int) as y from orders),
    m as (select *, case season when 'spring' then 3 when 'summer' then 6 when 'winter' then 12 else 9 end as a, case season when 'spring' then 5 when 'summer' then 8 when 'winter' then 2 else 11 end as b from s)
    select o_orderkey, make_date(y, a, 1) as date_from, last_day(make_date(case when a > b then y + 1 else y end, b, 1)) as date_to from m""",
)
def _(t, spark):
    df = t("orders").selectExpr("o_orderkey", "split('spring,summer,autumn,fall,winter', ',')[cast(o_orderkey % 5 as int)] as season", "cast(1990 + o_orderkey % 60 as int) as y")
    return df.select("o_orderkey", dt.season_range(F.col("season"), F.col("y")).alias("r")).select("o_orderkey", "r.*")


@query("dt_event_time", "select file_id, coalesce(taken_at, created_at) as event_time, cast(month(coalesce(taken_at, created_at)) as int) as m from files", ("files",))
def _(t, spark):
    at = dt.event_time(F.col("taken_at"), F.col("created_at"))
    return t("files").select("file_id", at.alias("event_time"), F.month(at).alias("m"))


# ---------------------------------------------------------------- vectors
SELF_JOIN = "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"


def _neighbours(t):
    a = t("embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id")


@query(
    "vec_normalize",
    """select vec_id, i - 1 as d, round(cast(embedding[i] as double) * 3 / (3 * sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)))), 6) as v
    from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) e""",
)
def _(t, spark):
    df = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    rows = df.select("vec_id", F.posexplode(vectors.normalize(F.col("e"))).alias("d", "v"))
    return rows.select("vec_id", F.col("d").cast("long").alias("d"), F.round("v", 6).alias("v"))


DOT = "list_dot_product(list_transform(a.embedding, lambda x: cast(x as double)), list_transform(b.embedding, lambda x: cast(x as double)))"


@query("vec_cosine", f"select a.vec_id, round({DOT}, 9) as cos {SELF_JOIN}")
def _(t, spark):
    return _neighbours(t).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 9).alias("cos"))


BASE_VECTOR = "list_transform(range(0, 64), lambda i: 0.125)"


@query("vec_margin", f"select a.vec_id, round({DOT} - list_dot_product({BASE_VECTOR}, list_transform(b.embedding, lambda x: cast(x as double))), 9) as margin {SELF_JOIN}")
def _(t, spark):
    base = F.array_repeat(F.lit(0.125), F.size("embedding"))
    return _neighbours(t).select("vec_id", F.round(vectors.margin(F.col("embedding"), F.col("other"), base), 9).alias("margin"))


@query(
    "vec_prob",
    f"""with c as (select a.vec_id, {DOT} as cos {SELF_JOIN})
    select vec_id, round(case when 110 * cos - 16 > -50 then 1 / (1 + exp(-(110 * cos - 16))) else 0 end, 9) as calibrated,
      round(least(1.0, greatest(0.0, (cos - 0.15) / 0.2)), 9) as squashed from c""",
)
def _(t, spark):
    df = _neighbours(t).select("vec_id", vectors.dot(F.col("embedding"), F.col("other")).alias("cos"))
    cos = F.col("cos")
    return df.select("vec_id", F.round(vectors.match_prob(cos, 110.0, -16.0), 9).alias("calibrated"), F.round(vectors.match_prob(cos, 110.0), 9).alias("squashed"))


@query("arr_api_score_scale", "select event_id, least(10, greatest(0, cast(floor(value) as bigint) % 14 - 2)) / 10.0 as score from events")
def _(t, spark):
    return t("events").select("event_id", vectors.scale_rating(F.floor("value") % 14 - 2).alias("score"))


# ---------------------------------------------------------------- geography and images
@query(
    "geo_dms_to_decimal",
    """with p as (select c_custkey, cast(c_custkey % 90 as string) as d, cast(c_custkey % 60 as string) as m, case when c_custkey % 9 = 0 then 'x' else cast(c_acctbal as string) end as s,
      split('N,S,E,W', ',')[c_custkey % 4 + 1] as ref from customer)
    select c_custkey, round(case when ref in ('S', 'W') then -1 else 1 end * (try_cast(d as double) + try_cast(m as double) / 60 + try_cast(s as double) / 3600), 6) as deg from p""",
)
def _(t, spark):
    df = t("customer").selectExpr(
        "c_custkey", "cast(c_custkey % 90 as string) d", "cast(c_custkey % 60 as string) m",
        "case when c_custkey % 9 = 0 then 'x' else cast(c_acctbal as string) end s", "split('N,S,E,W', ',')[cast(c_custkey % 4 as int)] ref",
    )
    return df.select("c_custkey", geo.dms_to_decimal(*[F.col(c) for c in ("d", "m", "s", "ref")]).alias("deg"))


@query(
    "geo_haversine",
    """select a.city_id, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))), 6) as km
    from cities a join cities b on b.city_id = a.city_id + 1""",
    ("cities",),
)
def _(t, spark):
    a = t("cities").select("city_id", "lat", "lon")
    b = a.select((F.col("city_id") - 1).alias("city_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "city_id").select("city_id", F.round(km, 6).alias("km"))


@query("geo_valid", "select file_id, coalesce(lat * 1.1 between -90 and 90 and lon * 1.1 between -180 and 180, false) as ok from files", ("files",))
def _(t, spark):
    return t("files").select("file_id", geo.valid_point(F.col("lat") * 1.1, F.col("lon") * 1.1).alias("ok"))


@query(
    "img_shape",
    """with s as (select file_id, case when file_id % 13 = 0 then 0 else width + file_id % 31 end as w, case when file_id % 13 = 0 then 0 else height end as h from files)
    select file_id, case when w > 0 and abs(w - h) < 0.05 * greatest(w, h) then 'square' when h > w then 'portrait vertical' else 'landscape horizontal' end as shape from s""",
    ("files",),
)
def _(t, spark):
    zero = F.col("file_id") % 13 == 0
    w, h = F.when(zero, 0).otherwise(F.col("width") + F.col("file_id") % 31), F.when(zero, 0).otherwise(F.col("height"))
    return t("files").select("file_id", geo.shape_words(w, h).alias("shape"))


# ---------------------------------------------------------------- arrays, JSON
@query("arr_explode_tags", "select file_id, unnest(tags) as tag from files", ("files",))
def _(t, spark):
    return t("files").select("file_id", F.explode("tags").alias("tag"))


@query("arr_tag_labels", "select file_id, array_to_string(list_transform(tags, lambda x: x), ',') as labels from files", ("files",))
def _(t, spark):
    scores = F.transform("tags", lambda x: F.struct(x.alias("label"), F.lit(0.5).alias("score")))
    return t("files").select("file_id", F.array_join(F.transform(scores, lambda s: s["label"]), ",").alias("labels"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(t, spark):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "set_ordered_unique",
    "select file_id, array_to_string(list_filter([kind, kind, coalesce(place_city, ''), place_country, coalesce(place_area, '')], lambda x, i: x is not null and x <> '' and list_position([kind, kind, coalesce(place_city, ''), place_country, coalesce(place_area, '')], x) = i), ', ') as parts from files",
    ("files",),
)
def _(t, spark):
    parts = tx.ordered_unique(F.array("kind", "kind"), F.array("place_city", "place_country", "place_area"))
    return t("files").select("file_id", F.array_join(parts, ", ").alias("parts"))


@query(
    "set_expand_merge_sources",
    "select file_id, array_to_string(list_filter([file_id % 3, file_id % 5, file_id % 7], lambda x, i: x <> file_id % 4 and list_position([file_id % 3, file_id % 5, file_id % 7], x) = i), ',') as sources from files",
    ("files",),
)
def _(t, spark):
    ids = F.array(*[F.col("file_id") % n for n in (3, 5, 7)])
    out = F.transform(pp.merge_sources(ids, F.col("file_id") % 4), lambda x: x.cast("string"))
    return t("files").select("file_id", F.array_join(out, ",").alias("sources"))


