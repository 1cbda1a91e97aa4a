"""Library tables derived from the generic driver tables, in one SQL text per table.

The text runs on Spark and, through `with_views`, on any engine with the same ANSI core; only two macros
differ: SHA(x) is the hex SHA-256, and PICK(list; expr; n) takes element `expr % n` of a comma list.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # every incoming document as an upload, exact copies included
    "uploads": """
        select doc_id as upload_id, doc_id % 5 as user_id, SHA(text) as file_hash, text, lang,
          concat(PICK(IMG_4412_goaBeachSunset,PXL_20240316_183012,Screenshot_2023-02-30-18,WhatsApp Image 2024-05-01 scanCopy,holiday_notes-final; doc_id; 5),
                 '_', cast(doc_id % 40 as string), PICK(.jpg,.PNG,.md,.txt,.pdf,.heic,.exe; doc_id; 7)) as name,
          PICK(image/jpeg,image/png,application/octet-stream,text/plain,video/mp4,image/heic; doc_id; 6) as mime,
          n_chars * (1 + doc_id % 4 * 9000) as size,
          PICK(,Trips,Trips//Goa: 2024,../Trips_old,Work\\50%,Work/50%/Notes; doc_id; 6) as folder,
          timestamp '2024-06-01 00:00:00' + interval '1' minute * cast(doc_id * 7919 % 525600 as int) as ts
        from {documents}""",
    # one row per (user, content)
    "files": """
        select user_id, file_id, file_hash, provider_id, provider_file_id, name, mime, size, status, created_at,
          taken_at, media_type, kind, tags, folder, embed_model, lat, lon, width, height, camera, place_name,
          place_area, place_city, place_region, place_country, faces_scanned, title, page_count, excerpt
        from (
          select user_id, upload_id as file_id, file_hash,
            cast(case when upload_id % 4 < 2 then 1 + upload_id % 4 else 2 + upload_id % 4 end as int) as provider_id,
            case when upload_id % 17 = 0 then null else concat('p', cast(upload_id as string)) end as provider_file_id,
            name, mime, size,
            case when upload_id % 20 = 0 then 'failed' when upload_id % 20 = 1 then 'indexing' else 'ready' end as status,
            timestamp '2024-01-01 00:00:00'
              + interval '1' minute * cast(upload_id * 7919 % 525600 as int) as created_at,
            case when upload_id % 4 = 0 then null else timestamp '2023-01-01 00:00:00'
              + interval '1' hour * cast(upload_id * 104729 % 17520 as int) end as taken_at,
            case when upload_id % 3 = 0 then 'document' else 'image' end as media_type,
            PICK(photo,screenshot,document,receipt,illustration,chart,meme; upload_id; 7) as kind,
            split(concat(PICK(beach,dog,food,night,party; upload_id; 5), ',', PICK(red,blue,snow; upload_id; 3)), ',') as tags,
            case when upload_id % 6 = 0 then '' when upload_id % 6 = 1 then 'Trips' when upload_id % 6 = 2 then 'Trips/Goa 2024'
              when upload_id % 6 = 3 then 'Trips_old' when upload_id % 6 = 4 then 'Work/50%' else 'Work/50%/Notes' end as folder,
            case when upload_id % 7 = 0 then null else PICK(m1,m2; upload_id; 2) end as embed_model,
            case when upload_id % 3 = 1 then null else cast(upload_id * 37 % 18000 as double) / 100 - 90 end as lat,
            case when upload_id % 3 = 1 then null else cast(upload_id * 7331 % 36000 as double) / 100 - 180 end as lon,
            cast(600 + upload_id % 9 * 100 as int) as width, cast(600 + upload_id % 5 * 100 as int) as height,
            case when upload_id % 3 = 0 then null else PICK(Canon EOS R5,Pixel 8,Nikon Z6; upload_id; 3) end as camera,
            case when upload_id % 8 = 0 then null else concat(PICK(Calangute,Dharavi,Alfama; upload_id; 3), ', ', PICK(Goa,Mumbai,Lisbon; upload_id; 3)) end as place_name,
            case when upload_id % 8 < 2 then null else PICK(Calangute,Dharavi,Alfama; upload_id; 3) end as place_area,
            case when upload_id % 8 = 0 then null else PICK(Goa,Mumbai,Lisbon; upload_id; 3) end as place_city,
            case when upload_id % 8 = 0 then null else concat('Region ', cast(upload_id % 90 as string)) end as place_region,
            case when upload_id % 8 = 0 then null else PICK(India,India,Portugal; upload_id; 3) end as place_country,
            upload_id % 10 <> 3 as faces_scanned,
            case when upload_id % 3 = 0 and upload_id % 9 <> 0 then concat('Title ', cast(upload_id as string)) else null end as title,
            cast(case when upload_id % 3 = 0 then 1 + upload_id % 4 else null end as int) as page_count,
            case when upload_id % 3 = 0 then lang else null end as excerpt,
            row_number() over (partition by user_id, file_hash order by upload_id) as copy_no
          from {uploads}) numbered
        where copy_no = 1""",
    # faces of 150 people over the first 200 files
    "faces": """
        select person_id % 5 as user_id, vec_id as face_id, vec_id * 7 % 40 * 5 + person_id % 5 as file_id, person_id,
          case when vec_id % 11 = 0 then null else cast(vec_id * 31 % 100 as double) / 100 end as score,
          timestamp '2024-01-01 00:00:00' + interval '1' minute * cast(vec_id * 613 % 5000 as int) as created_at,
          embedding
        from (select vec_id, embedding, label % 10 * 15 + vec_id * 13 % 15 as person_id from {embeddings}) e""",
    # people: every customer is one; only the first 150 have faces
    "people": """
        select c_custkey % 5 as user_id, c_custkey as person_id,
          case when c_custkey % 3 = 2 then null
               else concat(PICK(Rahul,Maya,Leo,Ana Maria,Zoe,Omar,Li Wei; c_custkey; 7), case when c_custkey < 7 then '' else concat(' ', cast(c_custkey as string)) end) end as name,
          c_custkey % 7 = 6 as hidden,
          timestamp '2024-01-01 00:00:00' + interval '1' hour * cast(c_custkey % 1000 as int) as created_at
        from {customer}""",
    "cities": """
        select c_custkey as city_id, c_name as name, cast(c_custkey * 7 % 17000 as double) / 100 - 85 as lat,
          cast(c_custkey * 3571 % 36000 as double) / 100 - 180 as lon, c_custkey * 7919 % 5000000 as population,
          r_name as region, n_name as country
        from {customer} c join {nation} n on c_nationkey = n_nationkey join {region} r on n_regionkey = r_regionkey""",
    "stage_events": """
        select event_id, concat(cast(user_id as string), '_', cast(event_id % 10 as string)) as flow_id, user_id,
          cast(ts as timestamp) as ts,
          case event_type when 'view' then 'upload' when 'click' then 'embed' when 'purchase' then 'faces'
            when 'signup' then 'docindex' else 'finalize' end as stage,
          case when value < 20 then 'failed' when value < 40 then 'active' when value < 50 then 'waiting'
            when value < 60 then 'delayed' when value < 65 then 'waiting-children' else 'completed' end as state,
          cast(event_id % 3 as int) as attempt, concat('reason ', cast(event_id % 13 as string)) as reason, props
        from {events}""",
    # enqueue / release pairs of the pending counter
    "queue_events": """
        select event_id, user_id, cast(ts as timestamp) as ts,
          concat(cast(user_id as string), '_', cast(event_id % 10 as string)) as flow_id,
          case when event_type in ('view', 'click', 'signup') then 1 else -1 end as delta
        from {events}""",
    "quota": """
        select s_nationkey % 5 as user_id,
          cast(case when s_suppkey % 4 < 2 then 1 + s_suppkey % 4 else 2 + s_suppkey % 4 end as int) as provider_id,
          s_acctbal + 2000 as total, abs(s_acctbal) as used, s_suppkey % 9 = 0 as failing
        from {supplier}""",
    # stored image vectors; hashes are those of the vector ids
    "image_index": """
        select vec_id % 5 as user_id, PICK(m1,m2; vec_id; 2) as embed_model, SHA(cast(vec_id as string)) as file_hash,
          vec_id, label, embedding, PICK(photo,screenshot,document,receipt,illustration,chart,meme; vec_id; 7) as kind
        from {embeddings}""",
    # a passage of every document; document d carries vector d, if there is one
    "passages": """
        select doc_id % 5 as user_id, SHA(cast(doc_id as string)) as file_hash, doc_id, vec_id,
          concat(coalesce(lang, ''), ' ', coalesce(source, '')) as title, cast(1 + doc_id % 3 as int) as page, 0 as chunk, text, embedding
        from {documents} d left join {embeddings} e on d.doc_id = e.vec_id""",
    # query vectors: every stored vector whose id is divisible by 20, asked by its own user
    "vector_queries": """
        select vec_id as query_id, vec_id % 5 as user_id, PICK(m1,m2; vec_id; 2) as embed_model, embedding
        from {embeddings} where vec_id % 20 = 0""",
    # keyword queries: the words of the benchmark items
    "keyword_queries": """
        select item_id as query_id, item_id % 5 as user_id, lower(text) as keywords from {benchmark}""",
    # natural-language queries
    "text_queries": """
        select item_id as query_id, item_id % 5 as user_id, date '2026-10-03' as today,
          concat(PICK(Photos of Rahul,show me Maya's dogs,beach,receipts,Leo and Zoe at a party,my screenshots,Rahul at the beach,red car; item_id; 8),
            PICK( in Goa, from Mumbai,, near Lisbon, in India; item_id; 5),
            PICK( last summer, yesterday, christmas 2023, in may,, two years ago, march 2024, 2022, last winter, past 3 weeks, last month, halloween 2021; item_id; 12)) as text
        from {benchmark}""",
}


def _dialect(sql: str, spark: bool) -> str:
    def pick(m: re.Match) -> str:
        items, expr, n = (part.strip() if i else part for i, part in enumerate(m.group(1).split(";")))
        index = f"cast({expr} % {n} as int)" if spark else f"{expr} % {n} + 1"
        if spark:
            items = items.replace("\\\\", "\\").replace("\\", "\\\\").replace("'", "\\'")
        else:
            items = items.replace("\\\\", "\\").replace("'", "''")
        return f"split('{items}', ',')[{index}]"

    sql = re.sub(r"PICK\((.*?; .*?; \d+)\)", pick, sql)
    return re.sub(r"SHA\((.*?)\) as", r"sha2(\1, 256) as" if spark else r"sha256(\1) as", sql)


def _inputs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a library table derived from it."""
    if name in BASE:
        return base_table(spark, sf_dir, name)
    parts = {i: view(spark, sf_dir, i) for i in _inputs(name)}
    return spark.sql(_dialect(VIEWS[name], spark=True), **parts)


def with_views(*names: str) -> str:
    """A WITH clause that defines the named library tables (and those they need) for the SQL oracle."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in order:
            return
        for i in _inputs(name):
            visit(i)
        order.append(name)

    for n in names:
        visit(n)
    body = ",\n".join(f"{n} as ({re.sub(r'{(' + chr(92) + 'w+)}', chr(92) + '1', _dialect(VIEWS[n], False))})" for n in order)
    return f"with {body}\n"


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A library table over a single driver table, with that table replayed as a file stream."""
    from ..streaming.streams import replay

    if name in BASE:
        return replay(spark, sf_dir, name)
    parts = {i: stream_view(spark, sf_dir, i) for i in _inputs(name)}
    return spark.sql(_dialect(VIEWS[name], spark=True), **parts)
