"""Documents to passages, and images to keyword text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.dates import date_words
from ..functions.geo import shape_words

DOC = ["user_id", "file_hash"]


def chunk_pages(pages: DataFrame, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """(user_id, file_hash, page, chunk, text): overlapping word windows that never cross a page.

    `pages`: user_id, file_hash, page_no (1-based order), page (shown number, null for plain text), text. Windows are cut
    per page row and numbered through the document by prefix sums in two levels (256 pages, then blocks of them),
    so a document of any length is spread over tasks.
    """
    cut = pages.withColumn("_words", tx.split_words(F.col("text"))).withColumn(
        "_chunks", tx.chunk_words(F.col("_words"), size, overlap)
    )
    cut = cut.drop("text", "_words").withColumn("_block", F.floor(F.col("page_no") / 256))
    inside = W.partitionBy(*DOC, "_block").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_before", F.coalesce(F.sum(F.size("_chunks")).over(inside), F.lit(0)))
    blocks = cut.groupBy(*DOC, "_block").agg(F.sum(F.size("_chunks")).alias("_n"))
    earlier = W.partitionBy(*DOC).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(*DOC, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    first = (F.col("_before") + F.col("_offset")).cast("int")
    numbered = local.join(offsets, [*DOC, "_block"]).withColumn("_first", first)
    rows = numbered.select(*DOC, "page", "_first", F.posexplode("_chunks").alias("_i", "text"))
    return rows.select(*DOC, "page", (F.col("_first") + F.col("_i")).alias("chunk"), "text")


def index_documents(docs: DataFrame, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Plain-text and Markdown documents to passages, one row per window, without any shuffle.

    `docs`: user_id, file_hash, filename, text. A document without text keeps one passage, its title, so it can still be
    found. `embed_input` is what a text model should embed.
    """
    # named columns: each is used more than once, and a lambda must not recompute the cleaning
    df = docs.withColumn("_clean", tx.clean_text(F.col("text"))).withColumn("title", tx.doc_title(F.col("text"), F.col("filename")))
    df = df.withColumn("_words", tx.split_words(F.col("_clean")))
    df = df.withColumn("_chunks", tx.chunk_words(F.col("_words"), size, overlap))
    texts = F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(F.array("title"))
    rows = df.select(*DOC, "title", F.posexplode(texts).alias("chunk", "text"))
    return rows.select(
        *DOC, "title", F.lit(None).cast("int").alias("page"), "chunk", "text", F.concat_ws(". ", "title", "text").alias("embed_input")
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """(user_id, file_hash, title-only page, page_count, excerpt, has_words) of documents by their pages, in one aggregate.

    Numbered pages are counted; a document of unnumbered ones has one page. The excerpt is that of the first page that isn't empty,
    cut before the shuffle. `pages` as in `chunk_pages`, with cleaned text.
    """
    text = F.coalesce("text", F.lit(""))
    excerpt = F.min(F.when(text != "", F.struct("page_no", tx.excerpt(text).alias("excerpt"))))["excerpt"]
    numbered = F.count("page")
    return pages.groupBy(*DOC).agg(
        F.when(F.coalesce(F.min_by("page", "page_no"), F.lit(0)) != 0, F.lit(1)).alias("title_page"),
        F.when(numbered > 0, numbered).otherwise(F.lit(1)).cast("int").alias("page_count"),
        F.coalesce(excerpt, F.lit("")).alias("excerpt"),
        F.max(F.size(tx.split_words(text)) > 0).alias("has_words"),
    )


def index_paged_documents(
    docs: DataFrame, pages: DataFrame, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP
) -> tuple[DataFrame, DataFrame]:
    """Paged documents to passages (as `index_documents` gives them) and cards: user_id, file_hash, title, page_count, excerpt.

    `docs`: user_id, file_hash, filename, heading (the title the file gives itself, or null); `pages` as in `chunk_pages`, text as extracted.
    A document none of whose pages has a word keeps one passage, its title, on page 1 if its pages are numbered; one without pages has page_count 0.
    """
    clean = pages.withColumn("text", tx.clean_text(F.coalesce("text", F.lit(""))))
    own = F.substring(F.nullif(tx.strip(F.col("heading")), F.lit("")), 1, fv.TITLE_CHARS)
    named = docs.select(*DOC, F.coalesce(own, tx.doc_title(F.lit(""), F.col("filename"))).alias("title")).join(page_facts(clean), DOC, "left")
    cards = named.select(*DOC, "title", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))
    bare = named.where(~F.coalesce("has_words", F.lit(False)))
    bare = bare.select(*DOC, "title", F.col("title_page").alias("page"), F.lit(0).alias("chunk"), F.col("title").alias("text"))
    full = chunk_pages(clean, size, overlap).join(named.select(*DOC, "title"), DOC).select(*bare.columns)
    rows = full.unionByName(bare)
    return rows.withColumn("embed_input", F.concat_ws(". ", "title", "text")), cards


def document_cards(docs: DataFrame) -> DataFrame:
    """title, page_count and excerpt of plain-text documents, each of one unnumbered page."""
    return docs.select(
        *DOC,
        tx.doc_title(F.col("text"), F.col("filename")).alias("title"),
        F.lit(1).alias("page_count"),
        tx.excerpt(tx.clean_text(F.col("text"))).alias("excerpt"),
    )


def search_text(
    kind: Column, tags: Column, name: Column, taken_at: Column, width: Column, height: Column, camera: Column, places: list[Column], lat: Column
) -> Column:
    """Keyword document of an image: what the vector cannot know (dates, names, camera, place)."""
    has_camera = F.coalesce(camera, F.lit("")) != ""
    parts = tx.ordered_unique(
        F.array(kind),
        F.coalesce(tags, F.array().cast("array<string>")),
        tx.filename_words(name),
        date_words(taken_at),
        F.array(shape_words(width, height)),
        F.array(F.when(has_camera, F.lower(camera))),
        F.array(*[F.lower(p) for p in places]),
        F.array(F.when(lat.isNotNull(), "geotagged location")),
    )
    return F.array_join(parts, " ")
