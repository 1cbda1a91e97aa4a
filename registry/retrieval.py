"""Retrieval: vectors, keywords, fusion, re-ranking, labels, geography, the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.functions import vectors as vc
from mediashelf.operators import bm25, geocode, ranking
from mediashelf.operators import vector_search as vs
from mediashelf.operators.library import top_k
from mediashelf.plans import search as sp
from mediashelf.session import cut_lineage

from . import query
from .understanding import UNDERSTOOD_CTE

DBL = "list_transform({0}, lambda x: cast(x as double))"


def dot(a, b):
    return f"round(list_dot_product({DBL.format(a)}, {DBL.format(b)}), 9)"


# ---------------------------------------------------------------- vectors
TOPN = f"""vn as (select * from (select q.query_id, i.file_hash, {dot('q.embedding', 'i.embedding')} as cos, row_number() over (partition by q.query_id order by {dot('q.embedding', 'i.embedding')} desc, i.file_hash) as rank
  from vector_queries q join image_index i on i.user_id = q.user_id and i.embed_model = q.embed_model) x where rank <= 36)"""
VQ = ("vector_queries", "image_index")


def candidates(t, n=36, extra=()):
    return vs.vector_search(t("vector_queries"), t("image_index"), n, extra=extra)


@query("vector_search", f"with {TOPN} select query_id, file_hash, round(cos, 6) as cos, rank from vn", VQ)
def _(t, spark):
    return candidates(t).select("query_id", "file_hash", F.round("cos", 6).alias("cos"), F.col("rank").cast("long").alias("rank"))


@query("topk_candidates", f"with {TOPN} select query_id, file_hash, rank from vn where rank <= 30", VQ)
def _(t, spark):
    """Over-fetch for k = 10, by the shuffled block plan."""
    out = vs.vector_search(t("vector_queries"), t("image_index"), ranking.image_candidates(10), small_batch=0)
    return out.select("query_id", "file_hash", F.col("rank").cast("long").alias("rank"))


@query(
    "vector_search_approx",
    "select q.query_id, true as complete, true as recalled from vector_queries q where exists (select 1 from image_index i where i.user_id = q.user_id and i.embed_model = q.embed_model)",
    VQ,
)
def _(t, spark):
    """Per query whether it got as many hits as the exact search, and nine tenths of the same ones."""
    found = vs.vector_search_approx(t("vector_queries"), t("image_index"), 10).select("query_id", "file_hash", F.lit(1).alias("got"))
    both = vs.vector_search(t("vector_queries"), t("image_index"), 10).select("query_id", "file_hash", F.lit(1).alias("best")).join(found, ["query_id", "file_hash"], "full_outer")
    seen = both.groupBy("query_id").agg(F.sum("got").alias("got"), F.sum("best").alias("best"), F.sum(F.col("got") * F.col("best")).alias("common"))
    return seen.select("query_id", (F.col("got") == F.col("best")).alias("complete"), (F.col("common") >= F.ceil(0.9 * F.col("best"))).alias("recalled"))


@query("win_topk_per_query", f"with {TOPN} select query_id, file_hash, rank from vn where rank <= 5", VQ)
def _(t, spark):
    best = top_k(candidates(t).drop("rank"), ["query_id"], [F.desc("cos"), F.asc("file_hash")], 5, rank="rank")
    return best.select("query_id", "file_hash", F.col("rank").cast("long").alias("rank"))


@query(
    "join_vector_lookup",
    "select i.user_id, i.embed_model, i.file_hash, round(cast(i.embedding[1] as double), 6) as v0 from image_index i where exists (select 1 from files f where f.user_id = i.user_id and f.embed_model = i.embed_model) and exists (select 1 from vector_queries q where q.query_id = i.vec_id)",
    ("image_index", "vector_queries", "files"),
)
def _(t, spark):
    keys = t("vector_queries").select("user_id", "embed_model", F.sha2(F.col("query_id").cast("string"), 256).alias("file_hash"))
    unknown = t("files").select("user_id", "embed_model", "file_hash")
    found = vs.lookup_vectors(keys.unionByName(unknown), t("image_index"))
    return found.select("user_id", "embed_model", "file_hash", F.round(F.col("embedding")[0].cast("double"), 6).alias("v0"))


@query(
    "ensemble_query_vector",
    """with d as (select label, unnest(range(1, 65)) as d, embedding from image_index), m as (select label, d, avg(cast(embedding[d] as double)) as m from d group by label, d),
    n as (select *, sqrt(sum(m * m) over (partition by label)) as norm from m) select label, d - 1 as d, round(m / norm, 6) as v from n""",
    ("image_index",),
)
def _(t, spark):
    mean = vs.mean_vectors(t("image_index"), ["label"])
    return mean.select("label", F.posexplode("embedding").alias("d", "v")).select("label", F.col("d").cast("long").alias("d"), F.round("v", 6).alias("v"))


PROTO = """tv as (select case when label < 4 then 'kind' else 'tag' end as grp, concat('L', cast(label as string)) as name, embedding from image_index),
  pd as (select grp, name, unnest(range(1, 65)) as d, embedding from tv), pm as (select grp, name, d, avg(cast(embedding[d] as double)) as m from pd group by all),
  pr as (select grp, name, list(m / norm order by d) as proto from (select *, sqrt(sum(m * m) over (partition by name)) as norm from pm) x group by grp, name)"""


def prototypes(t):
    templates = t("image_index").selectExpr("case when label < 4 then 'kind' else 'tag' end as grp", "concat('L', cast(label as string)) as name", "embedding")
    return vs.label_prototypes(templates)


@query("agg_label_matrix", f"with {PROTO} select grp, name, round(proto[1], 6) as first, round(proto[64], 6) as last from pr", ("image_index",))
def _(t, spark):
    v = F.col("embedding")
    return prototypes(t).select("grp", "name", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"))


@query(
    "zero_shot_classify",
    f"""with {PROTO}, s as (select i.vec_id, pr.grp, pr.name, list_dot_product({DBL.format('i.embedding')}, pr.proto) as cos from image_index i cross join pr),
    k as (select vec_id, name as kind from (select *, row_number() over (partition by vec_id order by round(cos, 9) desc, name) as r from s where grp = 'kind') x where r = 1),
    g as (select vec_id, name, 1 / (1 + exp(-(40 * cos - 5))) as p, row_number() over (partition by vec_id order by round(cos, 9) desc, name) as r from s where grp = 'tag')
    select k.vec_id, k.kind, coalesce(string_agg(g.name || '=' || printf('%.3f', round(g.p, 3)), ',' order by g.r), '') as tags from k left join g on g.vec_id = k.vec_id and g.r <= 8 and g.p >= 0.08 group by k.vec_id, k.kind""",
    ("image_index",),
)
def _(t, spark):
    out = vs.classify(t("image_index").select("vec_id", "embedding"), prototypes(t), 40.0, -5.0)
    tags = F.transform("tags", lambda x: F.concat(x["label"], F.lit("="), F.format_string("%.3f", x["score"])))
    return out.select("vec_id", "kind", F.array_join(tags, ",").alias("tags"))


@query(
    "refine_kind",
    """with f as (select *, file_id % 10 / 10.0 as receipt, file_id % 4 / 10.0 as doc, case when file_id % 19 = 0 then 'Android Screenshot tool' end as software from files)
    select file_id, case when contains(lower(name), 'screenshot') or contains(lower(coalesce(software, '')), 'screenshot') or contains(lower(name), 'screen shot') then 'screenshot'
      when camera is not null and receipt >= 0.3 then 'receipt' when camera is not null and doc >= 0.3 then 'document' when camera is not null then 'photo' else kind end as kind from f""",
    ("files",),
)
def _(t, spark):
    probs = F.create_map(F.lit("receipt"), F.col("file_id") % 10 / 10.0, F.lit("document"), F.col("file_id") % 4 / 10.0)
    software = F.when(F.col("file_id") % 19 == 0, "Android Screenshot tool")
    return t("files").select("file_id", vs.refine_kind(F.col("kind"), probs, F.col("camera"), software, F.col("name")).alias("kind"))


# ---------------------------------------------------------------- keywords
def tok(c):
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(docs, f1, f2, keys, name="bm", queries="keyword_queries"):
    """BM25 over two fields (boosts 2 and 1) of a relation with user_id, `keys`, f1, f2."""
    k = ", ".join(keys)
    on = " and ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""{name}_t as (select user_id, {k}, {tok(f1)} as a, {tok(f2)} as b from {docs}),
  {name}_s as (select user_id, count(*) as n, avg(len(a)) as la, avg(len(b)) as lb from {name}_t group by user_id),
  {name}_e as (select user_id, {k}, unnest(a) as term, 1 as f, len(a) as n1, len(b) as n2 from {name}_t union all select user_id, {k}, unnest(b), 2, len(a), len(b) from {name}_t),
  {name}_p as (select user_id, {k}, term, n1, n2, count(case when f = 1 then 1 end) as t1, count(case when f = 2 then 1 end) as t2 from {name}_e group by all),
  {name}_d as (select user_id, term, count(*) as df from {name}_p group by all),
  {name}_w as (select p.*, d.df, s.n as n_docs, ln(1 + (s.n - df + 0.5) / (df + 0.5)) as idf, 2 * t1 / (0.25 + 0.75 * coalesce(n1 / nullif(la, 0), 1)) + t2 / (0.25 + 0.75 * coalesce(n2 / nullif(lb, 0), 1)) as tf
    from {name}_p p join {name}_d d using (user_id, term) join {name}_s s using (user_id)),
  {name}_q as (select query_id, user_id, unnest(list_distinct({tok('keywords')})) as term from {queries}),
  {name} as (select query_id, user_id, {k}, round(sum(idf * tf / (1.2 + tf)), 9) as bm25 from {name}_q join {name}_w using (user_id, term) group by all)"""


PASSAGES = "ps as (select user_id, file_hash, doc_id, title, page, chunk, text from passages)"
DOC_BM = f"{PASSAGES}, {bm25_sql('ps', 'title', 'text', ['file_hash', 'chunk'])}"
KQ = ("keyword_queries", "passages")


@query("agg_bm25_stats", f"with {DOC_BM} select user_id, term, df, round(idf, 6) as idf, n_docs from (select distinct user_id, term, df, idf, n_docs from bm_w) x", KQ)
def _(t, spark):
    stats, df, _ = bm25.bm25_index(t("passages"), bm25.TITLE_AND_TEXT, ["user_id", "file_hash", "chunk"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(stats, "user_id").select("user_id", "term", "df", F.round(idf, 6).alias("idf"), "n_docs")


#: The 40 best passages of each query.
DOC_TOP = DOC_BM + ", top as (select * from (select bm.*, row_number() over (partition by query_id order by bm25 desc, file_hash, chunk) as best from bm) x where best <= 40)"


@query("keyword_search_docs", f"with {DOC_TOP} select query_id, file_hash, chunk, round(bm25, 6) as bm25 from top", KQ)
def _(t, spark):
    hits = bm25.bm25_search(t("keyword_queries"), t("passages"), bm25.TITLE_AND_TEXT, ["file_hash", "chunk"], n=40)
    return hits.select("query_id", "file_hash", "chunk", F.round("bm25", 6).alias("bm25"))


# images of the library carry the text of their document as keyword text
IMG = "im as (select f.user_id, f.file_hash, array_to_string(f.tags, ' ') as tags, u.text as search_text from files f join uploads u on u.upload_id = f.file_id)"
IMG_BM = f"{IMG}, {bm25_sql('im', 'tags', 'search_text', ['file_hash'])}"
IQ = ("files", "uploads", "keyword_queries")


def image_text(t):
    body = t("uploads").select(F.col("upload_id").alias("file_id"), F.col("text").alias("search_text"))
    return t("files").join(body, "file_id").select("user_id", "file_hash", "tags", "search_text")


@query("keyword_search", f"with {IMG_BM} select query_id, file_hash, round(bm25, 6) as bm25 from (select *, row_number() over (partition by query_id order by bm25 desc, file_hash) as r from bm) x where r <= 30", IQ)
def _(t, spark):
    hits = bm25.bm25_search(t("keyword_queries"), image_text(t), bm25.TAGS_AND_TEXT, ["file_hash"], n=30)
    return hits.select("query_id", "file_hash", F.round("bm25", 6).alias("bm25"))


# gate, blend and label of vector (sv) and keyword (kw) candidates
FUSE_TAIL = """al as (select coalesce(sv.query_id, kw.query_id) as query_id, coalesce(sv.file_hash, kw.file_hash) as file_hash, coalesce(prob, 0) as prob, coalesce(margin, -1) as margin, coalesce(bm25, 0) as bm25 from sv full outer join kw on sv.query_id = kw.query_id and sv.file_hash = kw.file_hash),
  mx as (select *, max(prob) over (partition by query_id) as best_p, max(bm25) over (partition by query_id) as best_kw from al),
  sc as (select *, case when best_kw > 0 then bm25 / best_kw else 0 end as kw, case when best_p > 0 then prob / best_p else 0 end as p_rel, margin >= 0.015 and prob >= best_p * 0.01 as visual from mx),
  fu as (select *, 0.75 * p_rel + 0.25 * kw as raw, case when visual and margin >= 0.05 then 'strong' when visual and margin >= 0.03 then 'good' when visual then 'possible' when kw > 0 then 'metadata' else 'possible' end as match from sc where visual or kw >= 0.6),
  hi as (select * from (select *, row_number() over (partition by query_id order by raw desc, prob desc, file_hash) as position from fu) x where position <= 12)"""

# ---------------------------------------------------------------- fusion of images
# keyword candidates of the vector queries: the best KEYWORD_BEST images of the same user and kind label, weighted by their id
KEYWORD_BEST = ranking.image_candidates(10)
FUSE_IN = f"""{TOPN}, sv as (select vn.query_id, vn.file_hash, 1 / (1 + exp(-(30 * cos - 6))) as prob, cos - {dot('i.embedding', "(select embedding from image_index where vec_id = 0)")} as margin from vn join image_index i on i.file_hash = vn.file_hash),
  kb as (select * from (select *, row_number() over (partition by user_id, label order by bm25 desc, file_hash) as best from (select user_id, label, file_hash, round(1.0 + vec_id % 17 / 3.0, 9) as bm25 from image_index) x) y where best <= {KEYWORD_BEST}),
  kw as (select q.query_id, i.file_hash, i.bm25 from vector_queries q join kb i on i.user_id = q.user_id and i.label = (q.query_id % 10)),
  """ + FUSE_TAIL


def fusion_inputs(t):
    baseline = t("image_index").filter("vec_id = 0").head().embedding  # the content-free caption: one vector
    near = candidates(t, extra=("embedding",))
    margin = F.col("cos") - F.round(vc.dot(F.lit(baseline), F.col("embedding")), 9)
    vec = near.select("query_id", "file_hash", vc.match_prob(F.col("cos"), 30.0, -6.0).alias("prob"), margin.alias("margin"))
    q = t("vector_queries").select("query_id", "user_id", (F.col("query_id") % 10).cast("int").alias("label"))
    weighed = t("image_index").select("user_id", "label", "file_hash", F.round(1.0 + F.col("vec_id") % 17 / 3.0, 9).alias("bm25"))
    best = top_k(weighed, ["user_id", "label"], [F.desc("bm25"), F.asc("file_hash")], KEYWORD_BEST)
    kw = q.join(best, ["user_id", "label"]).select("query_id", "file_hash", "bm25")
    return vec, kw


def fused(t, k=12):
    return ranking.fuse_images(*fusion_inputs(t), k)


@query("join_hybrid_full_outer", f"with {FUSE_IN} select query_id, file_hash, round(prob, 6) as prob, round(margin, 6) as margin, bm25 from al", VQ)
def _(t, spark):
    vec, kw = fusion_inputs(t)
    both = vec.join(kw, ["query_id", "file_hash"], "full_outer").na.fill({"prob": 0.0, "margin": -1.0, "bm25": 0.0})
    return both.select("query_id", "file_hash", F.round("prob", 6).alias("prob"), F.round("margin", 6).alias("margin"), "bm25")


@query("agg_max_norm", f"with {FUSE_IN} select query_id, file_hash, round(kw, 6) as kw, round(p_rel, 6) as p_rel from sc", VQ)
def _(t, spark):
    vec, kw = fusion_inputs(t)
    both = vec.join(kw, ["query_id", "file_hash"], "full_outer").na.fill({"prob": 0.0, "bm25": 0.0})
    return both.select("query_id", "file_hash", F.round(ranking.relative_to_best("bm25"), 6).alias("kw"), F.round(ranking.relative_to_best("prob"), 6).alias("p_rel"))


@query("fuse_images", f"with {FUSE_IN} select query_id, file_hash, round(raw, 4) as score, match, position from hi", VQ)
def _(t, spark):
    return fused(t).select("query_id", "file_hash", "score", "match", F.col("position").cast("long").alias("position"))


@query("match_label", f"with {FUSE_IN} select query_id, file_hash, case when margin >= 0.05 then 'strong' when margin >= 0.03 then 'good' when margin >= 0.015 then 'possible' when kw > 0 then 'metadata' else 'possible' end as match from sc", VQ)
def _(t, spark):
    vec, kw = fusion_inputs(t)
    both = vec.join(kw, ["query_id", "file_hash"], "full_outer").na.fill({"margin": -1.0, "bm25": 0.0})
    return both.select("query_id", "file_hash", ranking.match_label(F.col("margin"), F.col("bm25")).alias("match"))


@query(
    "rerank_mmr",
    "with recursive "
    + FUSE_IN
    + """, un as (select h.query_id, h.file_hash, h.position, h.match, round(h.raw, 4) as first, list_transform(i.embedding, lambda x: cast(x as double)) as e, list_transform(q.embedding, lambda x: cast(x as double)) as qe
      from hi h join vector_queries q on q.query_id = h.query_id left join image_index i on i.file_hash = h.file_hash and i.user_id = q.user_id and i.embed_model = q.embed_model),
    nn as (select *, e is not null as has, count(*) over (partition by query_id) > 2 and count(e) over (partition by query_id) >= 2 as active, count(e) over (partition by query_id) as held,
      row_number() over (partition by query_id, e is not null order by position) as p from un),
    pr as (select *, 1 / (1 + exp(-(30 * list_cosine_similarity(e, qe) - 6))) as pb from nn where has and active),
    rl as (select *, 0.6 * pb / max(pb) over (partition by query_id) + 0.4 * first / max(first) over (partition by query_id) as rel from pr),
    cd as (select a.query_id, a.p, a.rel, list(list_cosine_similarity(a.e, b.e) order by b.p) as sims from rl a join rl b on a.query_id = b.query_id group by all),
    mm as (select query_id, [p] as picked from (select query_id, p, row_number() over (partition by query_id order by rel desc, p) as r from cd) x where r = 1
      union all select query_id, picked from (select m.query_id, list_append(m.picked, c.p) as picked, row_number() over (partition by m.query_id
          order by 0.8 * c.rel - greatest(0, list_max(list_transform(m.picked, lambda x: c.sims[x])) - 0.85) desc, c.p) as r
        from mm m join cd c on c.query_id = m.query_id and not list_contains(m.picked, c.p)) x where r = 1),
    od as (select query_id, max_by(picked, len(picked)) as picked from mm group by query_id)
    select nn.query_id, nn.file_hash, nn.match, case when nn.active and nn.has then round(rl.rel, 4) else nn.first end as score,
      cast(case when not nn.active then nn.position when nn.has then list_position(picked, nn.p) else nn.held + nn.p end as bigint) as position
    from nn left join od on od.query_id = nn.query_id left join rl on rl.query_id = nn.query_id and rl.file_hash = nn.file_hash""",
    VQ,
)
def _(t, spark):
    hits = fused(t)
    owner = t("vector_queries").select("query_id", "user_id", "embed_model")
    vectors = hits.select("query_id", "file_hash").join(owner, "query_id").join(t("image_index"), ["user_id", "embed_model", "file_hash"])
    best = ranking.rerank_mmr(hits, vectors, t("vector_queries"), 30.0, -6.0)
    return best.select("query_id", "file_hash", "match", "score", F.col("position").cast("long").alias("position"))


@query(
    "rerank_external",
    f"""with {FUSE_IN}, rt as (select *, round(raw, 4) as score, case when position % 3 = 0 then null else least(10, greatest(0, (query_id + position * 7) % 13 - 1)) / 10.0 end as rating from hi)
    select query_id, file_hash, case when rating is null then match when rating >= 0.8 then 'strong' when rating >= 0.5 then 'good' else 'possible' end as match,
      row_number() over (partition by query_id order by rating desc nulls last, case when rating is not null then -score end, position) as position from rt""",
    VQ,
)
def _(t, spark):
    hits = fused(t)
    raw = (F.col("query_id") + F.col("position") * 7) % 13 - 1
    scores = hits.filter("position % 3 <> 0").select("query_id", "file_hash", vc.scale_rating(raw).alias("rating"))
    return ranking.rerank_with_scores(hits, scores).select("query_id", "file_hash", "match", F.col("position").cast("long").alias("position"))


# gate, best passage per document and rank of vector (pv) and keyword (pk) candidates over passages ps
def doc_tail(queries, k):
    return rf"""pu as (select query_id, file_hash, chunk, cos, 0.0 as bm25 from pv union all select query_id, file_hash, chunk, 0.0, bm25 from pk),
  pg as (select u.query_id, u.file_hash, p.page, p.text, min(u.chunk) as chunk, max(cos) as cos, max(bm25) as bm25 from pu u join ps p on p.file_hash = u.file_hash and p.chunk = u.chunk group by all),
  pm as (select *, max(cos) over (partition by query_id) as best, max(bm25) over (partition by query_id) as best_kw from pg),
  pn as (select pm.*, case when best_kw > 0 then pm.bm25 / best_kw else 0 end as kw, cos >= 0.2 and cos >= best - 0.15 as text_ok,
    list_filter(list_distinct(string_split_regex(lower(q.keywords), '[^\p{{L}}\p{{N}}_]+')), lambda x: length(x) > 2 and x not in ('the', 'and', 'for', 'with', 'about', 'from', 'that', 'this', 'what', 'how', 'are', 'was', 'pdf', 'pdfs', 'doc', 'docs')) as terms,
    list_distinct(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+')) as ws from pm join {queries} q using (query_id)),
  po as (select *, 0.7 * case when text_ok then least(1.0, greatest(0.0, (cos - 0.2) / greatest(best - 0.2, 1e-6))) else 0 end + 0.3 * kw as raw,
    case when not text_ok then 'keyword' when cos >= 0.3 then 'strong' when cos >= 0.25 then 'good' else 'possible' end as match
    from pn where text_ok or (kw >= 0.6 and case when len(terms) = 0 then 1 else len(list_intersect(terms, ws)) / len(terms) end >= 0.6)),
  pb as (select * from (select *, row_number() over (partition by query_id, file_hash order by raw desc, cos desc, page, chunk) as r from po) x where r = 1),
  ph as (select * from (select *, row_number() over (partition by query_id order by raw desc, cos desc, file_hash) as position from pb) x where position <= {k})"""


# ---------------------------------------------------------------- fusion of passages
GATE = dict(min_cos=0.2, good_cos=0.25, strong_cos=0.3, window=0.15)
# the query vector of keyword query q is stored vector q
DOC_FUSE = f"""{DOC_BM}, pv as (select query_id, file_hash, chunk, cos from (select q.query_id, p.file_hash, p.chunk, {dot('e.embedding', 'p.embedding')} as cos, row_number() over (partition by q.query_id order by {dot('e.embedding', 'p.embedding')} desc, concat(p.file_hash, ':', p.chunk)) as r
    from keyword_queries q join embeddings e on e.vec_id = q.query_id join passages p on p.user_id = q.user_id and p.embedding is not null) x where r <= 40),
  pk as (select query_id, file_hash, chunk, bm25 from (select *, row_number() over (partition by query_id order by bm25 desc, file_hash, chunk) as r from bm) x where r <= 40),
  """ + doc_tail("keyword_queries", 10)


def passage_inputs(t):
    passages = t("passages")
    q = t("keyword_queries")
    asked = q.join(t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").withColumn("filtered", F.lit(False))
    return asked, passages


def doc_hits(t, k=10):
    asked, passages = passage_inputs(t)
    return sp.document_hits(asked, passages, k, None, **GATE)


DQ = ("keyword_queries", "passages")


@query("fuse_docs", f"with {DOC_FUSE} select query_id, file_hash, page, chunk, round(raw, 4) as score, match, position from ph", DQ)
def _(t, spark):
    return doc_hits(t).select("query_id", "file_hash", "page", "chunk", "score", "match", F.col("position").cast("long").alias("position"))


@query("agg_best_per_doc", f"with {DOC_TOP} select query_id, file_hash, chunk from (select top.*, row_number() over (partition by query_id, file_hash order by bm25 desc, chunk) as r from top) x where r = 1", KQ)
def _(t, spark):
    hits = bm25.bm25_search(t("keyword_queries"), t("passages"), bm25.TITLE_AND_TEXT, ["file_hash", "chunk"], n=40)
    best = ranking.best_per_doc(hits.withColumns({"score": F.col("bm25"), "cos": F.lit(0.0), "page": F.lit(1)}))
    return best.select("query_id", "file_hash", "chunk")


@query(
    "sort_sections",
    f"""with {FUSE_IN}, {DOC_FUSE}, f as (select query_id, 'image' as section, match from hi where position = 1 union all select query_id, 'document', match from ph where position = 1),
    r as (select query_id, max(case when section = 'document' then case match when 'strong' then 3 when 'good' then 2 else 1 end end) as d, max(case when section = 'image' then case match when 'strong' then 3 when 'good' then 2 else 1 end end) as i from f group by query_id)
    select query_id, d is not null and coalesce(d, 0) >= coalesce(i, 0) as documents_first from r""",
    ("vector_queries", "image_index", "keyword_queries", "passages"),
)
def _(t, spark):
    images = fused(t).select("query_id", F.lit("image").alias("section"), "position", "match")
    docs = doc_hits(t).select("query_id", F.lit("document").alias("section"), "position", "match")
    return ranking.section_order(images.unionByName(docs))


# ---------------------------------------------------------------- geography
NEAR = """g as (select f.file_id, c.*, 2 * 6371.0 * asin(sqrt(pow(sin((radians(c.lat) - radians(f.lat)) / 2), 2) + cos(radians(f.lat)) * cos(radians(c.lat)) * pow(sin((radians(c.lon) - radians(f.lon)) / 2), 2))) as km from pts f cross join cities c where f.lat between -90 and 90 and f.lon between -180 and 180),
  n as (select * from (select *, row_number() over (partition by file_id order by km, city_id) as r from g) x where r = 1),
  b as (select * from (select *, row_number() over (partition by file_id order by population desc, city_id) as r from g where km <= 25) x where r = 1),
  z as (select n.file_id, n.km <= 40 and b.city_id is not null and b.city_id <> n.city_id and b.population >= 500000 and b.population >= 5 * greatest(n.population, 1) as metro, n.name as nearest, b.name as big, n.km, n.region, n.country from n left join b using (file_id)),
  o as (select file_id, case when metro then nearest end as area, case when metro then big when km <= 40 then nearest end as city, case when km <= 160 then region end as region, country from z)"""


def _geocode_sql(points):
    return f"""with pts as ({points}), {NEAR}
    select p.file_id, o.area as place_area, o.city as place_city, o.region as place_region, o.country as place_country,
      nullif(array_to_string(list_filter([o.area, o.city, o.region, o.country], lambda x, i: x is not null and list_position([o.area, o.city, o.region, o.country], x) = i), ', '), '') as place_name
    from pts p left join o using (file_id)"""


@query("reverse_geocode", _geocode_sql("select file_id, lat, lon from files"), ("files", "cities"))
def _(t, spark):
    return geocode.reverse_geocode(t("files").select("file_id", "lat", "lon"), t("cities")).drop("lat", "lon")


@query(
    "join_geo_nearest",
    _geocode_sql("select c_custkey as file_id, cast((c_custkey * 7 + 3) % 17000 as double) / 100 - 85 + 0.11 as lat, cast((c_custkey * 3571 + 5) % 36000 as double) / 100 - 180 as lon from customer"),
    ("cities",),
)
def _(t, spark):
    """Points close to cities, so that cities, areas and regions occur."""
    pts = t("customer").selectExpr("c_custkey as file_id", "cast((c_custkey * 7 + 3) % 17000 as double) / 100D - 85D + 0.11D as lat", "cast((c_custkey * 3571 + 5) % 36000 as double) / 100D - 180D as lon")
    return geocode.reverse_geocode(pts, t("cities")).drop("lat", "lon")


# ---------------------------------------------------------------- the whole search
def library(t):
    """files, faces, people, the images' vectors, and passages of all documents; file d carries vector d, if there is one."""
    files = t("files")
    vec = t("embeddings").select(F.col("vec_id").alias("file_id"), "embedding")
    body = t("uploads").select(F.col("upload_id").alias("file_id"), "text")
    rows = files.join(body, "file_id").join(vec, "file_id", "left")
    images = rows.filter("media_type = 'image' and embedding is not null").select(
        "user_id", F.lit("m1").alias("embed_model"), "file_hash", "embedding", "tags", F.concat_ws(" ", "kind", "place_name", F.array_join("tags", " ")).alias("search_text")
    )
    docs = rows.filter("media_type = 'document'").select("user_id", "file_hash", F.coalesce("title", "name").alias("title"), F.lit(1).alias("page"), F.lit(0).alias("chunk"), "text", "embedding")
    lib = {"files": files, "faces": t("faces").drop("embedding"), "people": t("people"), "image_index": images, "passages": docs}
    return {name: cut_lineage(table) for name, table in lib.items()}  # a library is stored tables


def text_queries(t):
    vec = t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return t("text_queries").join(vec, "query_id").select(
        "query_id", "user_id", "text", "today", F.lit("m1").alias("embed_model"), "embedding",
        F.transform("embedding", lambda x: (x * 0.01).cast("float")).alias("baseline"), F.col("embedding").alias("doc_embedding"),
    )


def run_search(t, rerank):
    out = sp.search(text_queries(t), library(t), k=12, scale=30.0, bias=-6.0, rerank=rerank, doc_gate=GATE)
    return out.withColumn("score", F.round("score", 3))


LIB_SQL = f"""im as (select f.user_id, f.file_hash, e.embedding, array_to_string(f.tags, ' ') as tags, concat_ws(' ', f.kind, f.place_name, array_to_string(f.tags, ' ')) as search_text from files f join embeddings e on e.vec_id = f.file_id where f.media_type = 'image'),
  ps as (select f.user_id, f.file_hash, e.embedding, coalesce(f.title, f.name) as title, 1 as page, 0 as chunk, u.text from files f left join embeddings e on e.vec_id = f.file_id join uploads u on u.upload_id = f.file_id where f.media_type = 'document')"""
SEARCH_SQL = f"""with {UNDERSTOOD_CTE}, {LIB_SQL},
  pi as (select user_id, lower(name) as low, min(person_id) as person_id from people where name is not null and not hidden group by all),
  a0 as (select u8.*, coalesce((select list(distinct person_id) from pi where pi.user_id = u8.user_id and list_contains(list_transform(coalesce(people, []), lambda p: lower(p)), low)), []) as ids from u8),
  fl as (select *, date_from is not null or date_to is not null or month is not null or coalesce(len(kinds), 0) > 0 or coalesce(len(places), 0) > 0 or coalesce(len(ids), 0) > 0 as filtered from a0),
  allow as (select q.query_id, f.user_id, f.file_hash, coalesce(f.taken_at, f.created_at) as event_time from fl q join files f on f.user_id = q.user_id and q.filtered and f.status <> 'failed' and f.provider_file_id is not null
    and (date_from is null or coalesce(taken_at, created_at) >= date_from) and (date_to is null or coalesce(taken_at, created_at) < date_to + 1) and (q.month is null or q.month = month(coalesce(taken_at, created_at)))
    and (coalesce(len(kinds), 0) = 0 or list_contains(kinds, kind))
    and (coalesce(len(places), 0) = 0 or len(list_filter(places, lambda p: coalesce(place_area ilike p, false) or coalesce(place_city ilike p, false) or coalesce(place_region ilike p, false) or coalesce(place_country ilike p, false))) > 0)
    and (coalesce(len(ids), 0) = 0 or len(ids) = (select count(distinct person_id) from faces x where x.user_id = f.user_id and x.file_id = f.file_id and list_contains(ids, x.person_id)))),
  lk as (select fl.query_id, fl.user_id, filtered, coalesce(visual_query, case when not filtered then trim(text) end) as visual, lower(coalesce(visual_query, case when not filtered then trim(text) end)) as keywords, e.embedding from fl join embeddings e on e.vec_id = fl.query_id),
  lo as (select * from lk where visual is not null),
  ok as (select lo.query_id, x.file_hash from lo join (select user_id, file_hash from im union all select user_id, file_hash from ps) x on x.user_id = lo.user_id where not filtered or exists (select 1 from allow a where a.query_id = lo.query_id and a.file_hash = x.file_hash)),
  vi as (select lo.query_id, im.file_hash, {dot('lo.embedding', 'im.embedding')} as cos, {dot('list_transform(lo.embedding, lambda x: cast(cast(x as double) * cast(0.01 as double) as float))', 'im.embedding')} as base from lo join im on im.user_id = lo.user_id join ok on ok.query_id = lo.query_id and ok.file_hash = im.file_hash),
  sv as (select query_id, file_hash, 1 / (1 + exp(-(30 * cos - 6))) as prob, cos - base as margin from (select *, row_number() over (partition by query_id order by cos desc, file_hash) as r from vi) x where r <= 36),
  {bm25_sql('im', 'tags', 'search_text', ['file_hash'], 'bi', 'lo')},
  kw as (select query_id, file_hash, bm25 from (select bi.*, row_number() over (partition by bi.query_id order by bm25 desc, bi.file_hash) as r from bi join ok on ok.query_id = bi.query_id and ok.file_hash = bi.file_hash) x where r <= 36),
  {FUSE_TAIL},
  {bm25_sql('ps', 'title', 'text', ['file_hash', 'chunk'], 'bd', 'lo')},
  pv as (select query_id, file_hash, chunk, cos from (select lo.query_id, p.file_hash, p.chunk, {dot('lo.embedding', 'p.embedding')} as cos, row_number() over (partition by lo.query_id order by {dot('lo.embedding', 'p.embedding')} desc, concat(p.file_hash, ':', p.chunk)) as r
    from lo join ps p on p.user_id = lo.user_id and p.embedding is not null join ok on ok.query_id = lo.query_id and ok.file_hash = p.file_hash) x where r <= 48),
  pk as (select query_id, file_hash, chunk, bm25 from (select bd.*, row_number() over (partition by bd.query_id order by bm25 desc, bd.file_hash, chunk) as r from bd join ok on ok.query_id = bd.query_id and ok.file_hash = bd.file_hash) x where r <= 48),
  {doc_tail('lo', 12)},
  nw as (select query_id, file_hash, position from (select a.*, row_number() over (partition by a.query_id order by event_time desc, a.file_hash) as position from allow a join lk on lk.query_id = a.query_id where lk.visual is null) x where position <= 12),
  rk as (select query_id, file_hash, match, position from hi where position <= 12 union all select query_id, file_hash, null, position from nw),
  rw as (select rk.*, f.media_type from rk join lk using (query_id) join files f on f.user_id = lk.user_id and f.file_hash = rk.file_hash)
  select query_id, 'image' as section, position, file_hash, match, cast(null as int) as page from rw where media_type <> 'document'
  union all select query_id, 'document', position, file_hash, match, cast(page as int) from ph
  union all select query_id, 'document', position, file_hash, null, null from rw where media_type = 'document' and query_id not in (select query_id from ph)"""


@query("search_pipeline")
def _(t, spark):
    return run_search(t, True)


@query("search_two_phase", SEARCH_SQL, ("text_queries", "people", "files", "faces", "uploads"))
def _(t, spark):
    """The fast first phase, without re-ranking."""
    out = run_search(t, False)
    return out.select("query_id", "section", F.col("position").cast("long").alias("position"), "file_hash", "match", "page")
