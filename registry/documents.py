"""Reading files, passages, and their keyed replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.operators import documents as dc
from mediashelf.session import shared_dir
from mediashelf.sources import sinks, uploads

from . import query
from .scalars import CLEAN_SQL


def text_tree(t, spark):
    """The documents as text files, one for each language, source and thousand ids, so that no folder has more."""
    root = shared_dir(spark, "tree")
    line = F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n")
    files = t("documents").groupBy("lang", "source", F.expr("doc_id div 1000").alias("block")).agg(text.alias("text"))
    files.write.partitionBy("lang", "source", "block").text(root)
    return root


#: What the files of text_tree hold.
TREE = """with f as (select coalesce(lang, '__HIVE_DEFAULT_PARTITION__') as lang, coalesce(source, '__HIVE_DEFAULT_PARTITION__') as source, doc_id // 1000 as block,
    string_agg(coalesce(text, '') || chr(10), '' order by doc_id, coalesce(text, '')) as body from documents group by all) """


@query("scan_text_files", TREE + "select lang, source, cast(length(body) as bigint) as n_chars, sha256(body) as text_sha256 from f")
def _(t, spark):
    docs = uploads.read_text_docs(spark, text_tree(t, spark))
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1).alias(name)
    return docs.select(part("lang"), part("source"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("scan_folder_tree", TREE + "select concat('lang=', lang, '/source=', source, '/block=', block) as folder, cast(strlen(body) as bigint) as size, sha256(body) as file_hash from f")
def _(t, spark):
    return uploads.read_tree(spark, text_tree(t, spark)).select("folder", "size", "file_hash")


@query(
    "scan_gazetteer",
    """select c_custkey as city_id, c_name as name, round(c_acctbal / 173, 4) as lat, cast(round(c_custkey * 0.01, 4) as double) as lon, case when c_custkey % 4 = 0 then 0 else c_custkey * 17 end as population,
    case when r_regionkey = 2 then null else r_name end as region, n_name as country from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""",
)
def _(t, spark):
    root = shared_dir(spark, "gazetteer")

    def write(name, df, columns):
        df.select(F.concat_ws("\t", *[F.coalesce(F.expr(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.text(f"{root}/{name}")

    rows = t("customer").join(t("nation"), F.expr("n_nationkey = c_nationkey"))
    blank = "''"
    write("cities15000.txt", rows, ["c_custkey", "c_name", "c_name", blank, "round(c_acctbal / 173, 4)", "round(c_custkey * 0.01, 4)", blank, blank, "concat('N', n_nationkey)", blank, "n_regionkey", blank, blank, blank, "if(c_custkey % 4 = 0, '', cast(c_custkey * 17 as string))", blank])
    codes = t("nation").join(t("region"), F.expr("r_regionkey = n_regionkey")).filter("r_regionkey <> 2")
    write("admin1CodesASCII.txt", codes, ["concat('N', n_nationkey, '.', n_regionkey)", "r_name", "r_name", blank])
    write("countryInfo.txt", t("nation"), ["concat('N', n_nationkey)", blank, blank, blank, "n_name"])
    out = uploads.load_gazetteer(spark, root)
    return out.withColumns({c: F.round(c, 4) for c in ("lat", "lon")})


INDEXED = rf"""c as (select user_id, file_hash, upload_id, {CLEAN_SQL} as body, coalesce(nullif(trim(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[_-]+', ' ', 'g')), ''), 'Untitled') as readable, name, text from uploads),
  w as (select *, case when regexp_matches(lower(name), '\.(md|markdown)$') then coalesce(nullif(trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)), ''), readable) else readable end as title0, list_filter(string_split_regex(body, '[\s\p{{Z}}]+'), lambda x: x <> '') as ws from c),
  k as (select user_id, file_hash, substring(title0, 1, 300) as title, ws, unnest(range(0, greatest(0, cast(ceil((len(ws) - 300) / 250.0) as bigint)) + 1)) as i from w),
  ix as (select user_id, file_hash, title, cast(i as int) as chunk, case when len(ws) = 0 then title else array_to_string(list_slice(ws, i * 250 + 1, i * 250 + 300), ' ') end as text from k)"""


def documents(t):
    return t("uploads").select("user_id", "file_hash", F.col("name").alias("filename"), "text")


@query("index_documents", f"with {INDEXED} select user_id, file_hash, title, chunk, sha256(text) as text_hash, length(concat(title, '. ', text)) as n from ix", ("uploads",))
def _(t, spark):
    out = dc.index_documents(documents(t))
    return out.select("user_id", "file_hash", "title", "chunk", F.sha2("text", 256).alias("text_hash"), F.length("embed_input").cast("long").alias("n"))


@query(
    "index_pages",
    r"""with w as (select conv_id, turn, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '') as ws from conversations),
    n as (select *, case when len(ws) = 0 then 0 else greatest(0, cast(ceil((len(ws) - 30) / 25.0) as bigint)) + 1 end as k from w),
    b as (select *, coalesce(sum(k) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from n),
    r as (select *, unnest(range(0, k)) as i from b)
    select conv_id, cast(turn as int) as page, cast(before + i as bigint) as chunk, sha256(array_to_string(list_slice(ws, i * 25 + 1, i * 25 + 30), ' ')) as text_hash from r""",
)
def _(t, spark):
    """Multi-page documents (a conversation's turns are its pages): windows never cross a page."""
    pages = t("conversations").select(F.lit(0).alias("user_id"), F.col("conv_id").alias("file_hash"), F.col("turn").alias("page_no"), F.col("turn").cast("int").alias("page"), "text")
    out = dc.chunk_pages(pages, size=30, overlap=5)
    return out.select(F.col("file_hash").alias("conv_id"), "page", F.col("chunk").cast("long").alias("chunk"), F.sha2("text", 256).alias("text_hash"))


EXCERPT_SQL = r"substring(regexp_replace(regexp_replace(regexp_replace(text, '[#*_`>]+', '', 'g'), '[\s\p{Z}]+', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 1, 400)"

# a conversation's turns as the pages of a document: some without words, some unnumbered
PAGED = r"""p0 as (select conv_id, turn, case when conv_id % 5 = 0 then null else cast(turn + 1 as int) end as page, case when conv_id % 9 = 0 then '' else coalesce(text, '') end as text from conversations),
    p as (select conv_id, turn, page, CLEAN as text from p0),
    pw as (select *, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '') as ws from p),
    d as (select conv_id, case when conv_id % 4 = 0 then concat('Talk ', conv_id) else concat('minutes of ', conv_id) end as title from conversations group by conv_id),
    fa as (select conv_id, arg_min(coalesce(page, 0), turn) as first_page, count(page) as numbered, max(len(ws)) as most,
      first(EXCERPT order by turn) filter (where text <> '') as excerpt from pw group by conv_id)""".replace("CLEAN", CLEAN_SQL).replace("EXCERPT", EXCERPT_SQL)


def paged(t):
    key = (F.lit(0).alias("user_id"), F.col("conv_id").alias("file_hash"))
    page = F.expr("if(conv_id % 5 = 0, null, cast(turn + 1 as int))").alias("page")
    pages = t("conversations").select(*key, F.col("turn").alias("page_no"), page, F.expr("if(conv_id % 9 = 0, '', text)").alias("text"))
    name, heading = F.concat(F.lit("minutes_of-"), "conv_id", F.lit(".pdf")).alias("filename"), F.expr("if(conv_id % 4 = 0, concat(' Talk ', conv_id), '')").alias("heading")
    return dc.index_paged_documents(t("conversations").select("conv_id").distinct().select(*key, name, heading), pages, size=30, overlap=5)


@query(
    "index_paged_documents",
    f"""with {PAGED}, n as (select *, case when len(ws) = 0 then 0 else greatest(0, cast(ceil((len(ws) - 30) / 25.0) as bigint)) + 1 end as k from pw),
    b as (select *, coalesce(sum(k) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from n),
    r as (select *, unnest(range(0, k)) as i from b),
    x as (select conv_id, page, cast(before + i as bigint) as chunk, array_to_string(list_slice(ws, i * 25 + 1, i * 25 + 30), ' ') as text from r
      union all select conv_id, case when first_page <> 0 then 1 end, 0, title from fa join d using (conv_id) where most = 0)
    select x.conv_id, title, page, chunk, sha256(text) as text_hash, length(concat(title, '. ', text)) as n from x join d on d.conv_id = x.conv_id""",
)
def _(t, spark):
    out = paged(t)[0]
    return out.select(F.col("file_hash").alias("conv_id"), "title", "page", F.col("chunk").cast("long").alias("chunk"), F.sha2("text", 256).alias("text_hash"), F.length("embed_input").cast("long").alias("n"))


@query(
    "index_document_cards",
    f"""with {INDEXED}, {PAGED}
    select 'paged' as origin, cast(conv_id as varchar) as id, title, case when numbered > 0 then cast(numbered as int) else 1 end as page_count, sha256(coalesce(excerpt, '')) as excerpt_hash from d join fa using (conv_id)
    union all select 'plain', concat(user_id, ':', file_hash), substring(title0, 1, 300), 1, sha256({EXCERPT_SQL.replace("text", "body")}) from w""",
    ("uploads",),
)
def _(t, spark):
    """Cards of paged documents and of plain-text ones."""

    def rows(cards, origin, name):
        return cards.select(F.lit(origin).alias("origin"), name.cast("string").alias("id"), "title", "page_count", F.sha2("excerpt", 256).alias("excerpt_hash"))

    plain = rows(dc.document_cards(documents(t)), "plain", F.concat_ws(":", "user_id", "file_hash"))
    return rows(paged(t)[1], "paged", F.col("file_hash")).unionByName(plain)


@query(
    "sink_replace_passages",
    f"""with {INDEXED}, fresh as (select user_id, file_hash, title, chunk, text from ix where exists (select 1 from uploads u where u.user_id = ix.user_id and u.file_hash = ix.file_hash and u.lang = 'es')),
    old as (select user_id, file_hash, title, chunk, text from passages)
    select user_id, file_hash, title, chunk, sha256(text) as text_hash from (select * from old o where not exists (select 1 from fresh f where f.user_id = o.user_id and f.file_hash = o.file_hash) union all select * from fresh) x""",
    ("uploads", "passages"),
)
def _(t, spark):
    columns = ["user_id", "file_hash", "title", "chunk", "text"]
    spanish = t("uploads").filter("lang = 'es'").select("user_id", "file_hash")
    fresh = dc.index_documents(documents(t).join(spanish, ["user_id", "file_hash"], "left_semi")).select(*columns)
    out = sinks.replace_documents(t("passages").select(*columns), fresh)
    return out.select("user_id", "file_hash", "title", "chunk", F.sha2("text", 256).alias("text_hash"))
