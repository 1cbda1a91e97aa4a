"""The search pipeline for a table of queries, for all users at once.

understand -> structured filters -> vector and keyword candidates inside the allowed files -> gate and blend ->
re-rank -> join to rows. Every stage is a DataFrame; only the understood queries and the allow-list, which several
branches read, are written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import snippet
from ..functions.vectors import dot, match_prob
from ..operators import library as lb
from ..operators.bm25 import TAGS_AND_TEXT, TITLE_AND_TEXT, bm25_search
from ..operators.people import named_people
from ..operators.ranking import fuse_images, fuse_passages, image_candidates, passage_candidates, rerank_mmr
from ..operators.understand import understand_queries
from ..operators.vector_search import vector_search
from ..session import cut_lineage

PASSAGE = ["file_hash", "page", "chunk", "text"]


def image_hits(
    asked: DataFrame, image_index: DataFrame, k: int, scale: float, bias: float | None = None, allow: DataFrame | None = None, **gate
) -> DataFrame:
    """Fused image hits. `asked`: query_id, user_id, embed_model, embedding, baseline, keywords, filtered."""
    n = image_candidates(k)
    base = asked.select("query_id", "baseline")
    near = vector_search(asked, image_index, n, allow=allow, extra=("embedding",))
    scored = near.join(base, "query_id").select(
        "query_id",
        "file_hash",
        match_prob(F.col("cos"), scale, bias).alias("prob"),
        (F.col("cos") - F.round(dot(F.col("baseline"), F.col("embedding")), 9)).alias("margin"),
    )
    words = bm25_search(asked, image_index, TAGS_AND_TEXT, ["file_hash"], n, allow)
    return fuse_images(scored, words, k, **gate)


def document_hits(asked: DataFrame, passages: DataFrame, k: int, allow: DataFrame | None = None, **gate) -> DataFrame:
    """Fused document hits: the best passage of each. `asked`: query_id, user_id, embedding, keywords, filtered.

    Only the candidates carry passage text; the search itself moves ids. Passages without a vector are found by their words only.
    """
    n = passage_candidates(k)
    ids = passages.withColumn("pid", F.concat_ws(":", "file_hash", F.col("chunk").cast("string")))
    by_passage = None if allow is None else allow.join(ids.select("user_id", "file_hash", "pid"), ["user_id", "file_hash"])
    index = ids.filter("embedding is not null").select("user_id", F.col("pid").alias("file_hash"), "embedding")
    passage_allow = None if by_passage is None else by_passage.select("query_id", F.col("pid").alias("file_hash"))
    near = vector_search(asked.drop("embed_model"), index, n, allow=passage_allow, space=["user_id"])
    words = bm25_search(asked, passages, TITLE_AND_TEXT, ["file_hash", "chunk"], n, allow)
    # both lists as ids, merged, then one lookup of the passages themselves
    zero = F.lit(0.0)
    owner = asked.select("query_id", "user_id")
    near = near.withColumnRenamed("file_hash", "pid").join(owner, "query_id")
    pid = F.concat_ws(":", "file_hash", F.col("chunk").cast("string")).alias("pid")
    both = near.select("query_id", "user_id", "pid", "cos", zero.alias("bm25")).unionByName(
        words.select("query_id", "user_id", pid, zero.alias("cos"), "bm25")
    )
    # written, as its size then shows that it can be shipped: at most 2 n rows a query, while the passages' texts stay where they are
    merged = cut_lineage(both.groupBy("query_id", "user_id", "pid").agg(F.max("cos").alias("cos"), F.max("bm25").alias("bm25")))
    found = merged.join(ids.select("user_id", "pid", *PASSAGE), ["user_id", "pid"])
    return fuse_passages(found, asked, k, **gate)


def understood(queries: DataFrame, lib: dict[str, DataFrame]) -> DataFrame:
    """Queries with filters, person ids, what to search for (visual, null = filters only) and keywords."""
    people = named_people(lib["people"])
    u = understand_queries(queries, people, lb.known_places(lib["files"]))
    ids = people.groupBy("user_id", F.lower("name").alias("_low")).agg(F.min("person_id").alias("person_id"))
    named = (
        u.select("query_id", "user_id", F.explode("people").alias("_name"))
        .withColumn("_low", F.lower("_name"))
        .join(ids, ["user_id", "_low"])
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("person_id")).alias("person_ids"))
    )
    none = F.array().cast(f"array<{lib['people'].schema['person_id'].dataType.simpleString()}>")
    u = u.join(named, "query_id", "left").withColumn("person_ids", F.coalesce("person_ids", none))
    u = u.withColumn("filtered", lb.has_filters(u))
    visual = F.coalesce("visual_query", F.when(~F.col("filtered"), F.trim("text")))
    u = u.withColumn("visual", visual)
    # once understood, names and dates are filters: keywords see only the visual part
    return u.withColumn("keywords", F.lower("visual"))


def search(
    queries: DataFrame,
    lib: dict[str, DataFrame],
    k: int = 30,
    scale: float = 100.0,
    bias: float | None = None,
    rerank: bool = True,
    image_gate: dict | None = None,
    doc_gate: dict | None = None,
) -> DataFrame:
    """Answers of a batch of queries: query_id, section, position, file columns, score, match, page, snippet.

    `queries`: query_id, user_id, text, today, and the vectors of what is searched for: embed_model, embedding,
    baseline (image model) and doc_embedding (text model). `lib`: files, faces, people, image_index, passages.
    """
    vectors = queries.select("query_id", "embed_model", "embedding", "baseline", "doc_embedding")
    asked = cut_lineage(understood(queries.select("query_id", "user_id", "text", "today"), lib))
    allow = cut_lineage(lb.resolve_filters(asked, lib["files"], lib["faces"]))
    looking = asked.filter("visual is not null").select("query_id", "user_id", "keywords", "visual", "filtered").join(vectors, "query_id")

    n = max(k, fv.RERANK_TOP_N)
    images = image_hits(looking, lib["image_index"], n, scale, bias, allow, **(image_gate or {}))
    images = cut_lineage(images)  # at most k rows per query, read by the second pass and by the answer
    if rerank:
        images = second_pass(images, looking, lib["image_index"], scale, bias)
    docs = document_hits(
        looking.drop("embedding").withColumnRenamed("doc_embedding", "embedding"), lib["passages"], n, allow, **(doc_gate or {})
    )
    docs = cut_lineage(docs)
    only_filters = asked.filter("visual is null").select("query_id")
    newest = lb.newest(allow.join(only_filters, "query_id", "left_semi"), lib["files"], k)

    none = F.lit(None)
    ranked = images.select("query_id", "file_hash", "score", "match", "position").unionByName(
        newest.select("query_id", "file_hash", F.lit(1.0).alias("score"), none.cast("string").alias("match"), "position")
    )
    files = lib["files"].select("user_id", "file_hash", "file_id", "name", "media_type")
    owner = asked.select("query_id", "user_id", "visual")
    rows = lb.hydrate(ranked.filter(F.col("position") <= k).join(owner, "query_id"), files)
    blank = {"page": none.cast("int"), "snippet": none.cast("string")}
    shown = rows.filter("media_type <> 'document'").withColumns(blank | {"section": F.lit("image")})
    found_docs = lb.hydrate(docs.join(owner, "query_id"), files)
    found_docs = found_docs.withColumn("snippet", snippet(F.col("text"), F.col("visual"))).withColumn("section", F.lit("document"))
    # files of a pure filter query that are documents, when no passage answered
    as_docs = rows.filter("media_type = 'document'").join(docs.select("query_id").distinct(), "query_id", "left_anti")
    as_docs = as_docs.withColumns(blank | {"section": F.lit("document"), "match": none.cast("string")})
    out = ["query_id", "section", "position", "file_hash", "file_id", "name", "score", "match", "page", "snippet"]
    return shown.select(*out).unionByName(found_docs.select(*out)).unionByName(as_docs.select(*out))


def second_pass(images: DataFrame, looking: DataFrame, image_index: DataFrame, scale: float, bias: float | None = None) -> DataFrame:
    """The re-ranked order, applied to a first-phase answer (run later, from kept candidates, if preferred)."""
    owner = looking.select("query_id", "user_id", "embed_model")
    vectors = images.select("query_id", "file_hash").join(owner, "query_id")
    vectors = vectors.join(image_index.select("user_id", "embed_model", "file_hash", "embedding"), ["user_id", "embed_model", "file_hash"])
    return rerank_mmr(images, vectors, looking, scale, bias)
