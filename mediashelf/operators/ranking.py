"""Fusing vector and keyword candidates, relevance labels, and re-ranking.

Scores are compared in full precision and rounded only on output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as fv
from ..functions.text import term_coverage
from .library import top_k


def _best(c: str) -> Column:
    """Maximum over a query's candidates, which are over-fetched top-n lists and so bounded."""
    return F.max(c).over(W.partitionBy("query_id"))


def image_candidates(k: int) -> int:
    return max(3 * k, 30)


def passage_candidates(k: int) -> int:
    return max(4 * k, 40)


def match_label(margin: Column, keyword: Column, min_margin: float = fv.MIN_MARGIN) -> Column:
    return (
        F.when(margin >= fv.STRONG_MARGIN, "strong")
        .when(margin >= fv.GOOD_MARGIN, "good")
        .when(margin >= min_margin, "possible")
        .when(keyword > 0, "metadata")
        .otherwise("possible")
    )


def external_label(score: Column) -> Column:
    return F.when(score >= 0.8, "strong").when(score >= 0.5, "good").otherwise("possible")


def relative_to_best(c: str) -> Column:
    best = _best(c)
    return F.when(best > 0, F.col(c) / best).otherwise(F.lit(0.0))


def fuse_images(
    vector: DataFrame,
    keyword: DataFrame,
    k: int | Column,
    alpha: float = 0.75,
    min_margin: float = fv.MIN_MARGIN,
    strong_keyword: float = 0.6,
    relative_floor: float = 0.01,
) -> DataFrame:
    """Gate, blend and label image candidates.

    `vector`: query_id, file_hash, prob, margin. `keyword`: query_id, file_hash, bm25. An image passes when its
    margin clears min_margin and its probability is within relative_floor of the best, or when its keyword score
    is a strong share of the best one. Returns query_id, file_hash, score, prob, margin, match, position.
    """
    both = vector.select("query_id", "file_hash", "prob", "margin").join(
        keyword.select("query_id", "file_hash", "bm25"), ["query_id", "file_hash"], "full_outer"
    )
    c = both.na.fill({"prob": 0.0, "margin": -1.0, "bm25": 0.0})
    c = c.withColumn("kw", relative_to_best("bm25")).withColumn("p_rel", relative_to_best("prob"))
    best = _best("prob")
    c = c.withColumn("_visual", (F.col("margin") >= min_margin) & (F.col("prob") >= best * relative_floor))
    c = c.filter(F.col("_visual") | (F.col("kw") >= strong_keyword))
    score = alpha * F.col("p_rel") + (1 - alpha) * F.col("kw")
    label = match_label(F.when(F.col("_visual"), F.col("margin")).otherwise(F.lit(-1.0)), F.col("kw"), min_margin)
    c = c.withColumn("score", score).withColumn("match", label)
    order = [F.desc("score"), F.desc("prob"), F.asc("file_hash")]
    return top_k(c, ["query_id"], order, k, rank="position").select(
        "query_id",
        "file_hash",
        F.round("score", 4).alias("score"),
        F.round("prob", 4).alias("prob"),
        F.round("margin", 4).alias("margin"),
        "match",
        "position",
    )


def fuse_docs(vector: DataFrame, keyword: DataFrame, queries: DataFrame, k: int | Column, **gate) -> DataFrame:
    """`fuse_passages` of separate candidate lists.

    `vector`: query_id, file_hash, page, chunk, text, cos. `keyword`: the same with bm25.
    """
    cols = ["query_id", "file_hash", "page", "chunk", "text"]
    zero = F.lit(0.0)
    both = vector.select(*cols, "cos", zero.alias("bm25")).unionByName(keyword.select(*cols, zero.alias("cos"), "bm25"))
    return fuse_passages(both, queries, k, **gate)


def fuse_passages(
    candidates: DataFrame,
    queries: DataFrame,
    k: int | Column,
    min_cos: float = 0.82,
    good_cos: float = 0.84,
    strong_cos: float = 0.87,
    window: float = 0.06,
    strong_keyword: float = 0.6,
    alpha: float = 0.7,
    min_coverage: float = 0.6,
) -> DataFrame:
    """Gate passages, keep the best of each document, label and rank.

    `candidates`: query_id, file_hash, page, chunk, text, cos, bm25 (0 where a search did not find the passage; equal
    texts on one page count once). `queries`: query_id, keywords (for term coverage). A passage passes on similarity
    (absolute floor and close to the best) or on keywords (strong share of the best score and most query words present).
    """
    zero = F.lit(0.0)
    c = candidates.groupBy("query_id", "file_hash", F.coalesce("page", F.lit(0)).alias("page"), "text").agg(
        F.min("chunk").alias("chunk"), F.max("cos").alias("cos"), F.max("bm25").alias("bm25")
    )
    best = _best("cos")
    c = c.withColumn("kw", relative_to_best("bm25")).withColumn("_best", best)
    c = c.withColumn("_text_ok", (F.col("cos") >= min_cos) & (F.col("cos") >= F.col("_best") - window))
    c = c.filter(F.col("_text_ok") | (F.col("kw") >= strong_keyword))
    c = c.join(queries.select("query_id", "keywords"), "query_id", "left")
    covered = term_coverage(F.coalesce("keywords", F.lit("")), F.col("text")) >= min_coverage
    c = c.filter(F.col("_text_ok") | covered)
    span = F.greatest(F.col("_best") - min_cos, F.lit(1e-6))
    rel = F.least(F.lit(1.0), F.greatest(zero, (F.col("cos") - min_cos) / span))
    score = alpha * F.when(F.col("_text_ok"), rel).otherwise(zero) + (1 - alpha) * F.col("kw")
    label = (
        F.when(~F.col("_text_ok"), "keyword")
        .when(F.col("cos") >= strong_cos, "strong")
        .when(F.col("cos") >= good_cos, "good")
        .otherwise("possible")
    )
    c = c.withColumn("score", score).withColumn("match", label)
    one = best_per_doc(c)
    order = [F.desc("score"), F.desc("cos"), F.asc("file_hash")]
    return top_k(one, ["query_id"], order, k, rank="position").select(
        "query_id",
        "file_hash",
        F.nullif(F.col("page"), F.lit(0)).alias("page"),
        "chunk",
        "text",
        F.round("score", 4).alias("score"),
        F.round("cos", 4).alias("cos"),
        "match",
        "position",
    )


def best_per_doc(passages: DataFrame) -> DataFrame:
    order = [F.desc("score"), F.desc("cos"), F.asc("page"), F.asc("chunk")]
    return top_k(passages, ["query_id", "file_hash"], order, 1)


def section_order(hits: DataFrame) -> DataFrame:
    """Per query: do documents come first? `hits`: query_id, section ('image' | 'document'), position, match."""
    rank = F.when(F.col("match") == "strong", 3).when(F.col("match") == "good", 2).otherwise(1)

    shown = F.when(F.col("match").isNull(), 0).otherwise(rank)
    top = hits.groupBy("query_id").agg(
        *[F.min_by(shown, F.when(F.col("section") == s, F.col("position"))).alias(s) for s in ("document", "image")]
    )
    docs_first = F.col("document").isNotNull() & (F.coalesce("document", F.lit(0)) >= F.coalesce("image", F.lit(0)))
    return top.select("query_id", docs_first.alias("documents_first"))


# ---------------------------------------------------------------- second pass
def mmr_order(v: np.ndarray, rel: np.ndarray, diversity: float) -> list[int]:
    """Greedy maximal marginal relevance; near-duplicates (similarity above 0.85) of chosen rows lose relevance."""
    sim = v @ v.T
    nearest = np.full(len(rel), -np.inf)
    left = np.ones(len(rel), dtype=bool)
    order: list[int] = []
    for step in range(len(rel)):
        gain = rel if step == 0 else (1 - diversity) * rel - diversity * np.clip(nearest - 0.85, 0, None) * 5
        pick = int(np.argmax(np.where(left, gain, -np.inf)))
        order.append(pick)
        left[pick] = False
        nearest = np.maximum(nearest, sim[pick])
    return order


def rerank_mmr(
    hits: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    scale: float,
    bias: float | None = None,
    top_n: int = fv.RERANK_TOP_N,
    diversity: float = 0.2,
) -> DataFrame:
    """Re-order the first top_n hits of each query by relevance and diversity; later hits keep their order.

    `hits`: query_id, file_hash, score, position. `vectors`: query_id, file_hash, embedding. `query_vectors`:
    query_id, embedding (the prompt ensemble's mean). Queries with two hits or fewer stay as they are. A group is
    one query's hits, at most k rows.
    """
    rows = hits.join(vectors.select("query_id", "file_hash", "embedding"), ["query_id", "file_hash"], "left").join(
        query_vectors.select("query_id", F.col("embedding").alias("_query")), "query_id", "left"
    )
    types = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = f"query_id {types['query_id']}, file_hash string, score double, position int"

    def reorder(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        head, tail = pdf.iloc[:top_n], pdf.iloc[top_n:]
        have = head[head["embedding"].notna() & head["_query"].notna()]
        if len(pdf) > 2 and len(have) >= 2:
            v = np.vstack(have["embedding"].to_numpy()).astype(np.float64)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            q = np.asarray(have["_query"].iloc[0], dtype=np.float64)
            cos = v @ (q / (np.linalg.norm(q) or 1.0))
            z = None if bias is None else scale * cos + bias
            p = np.clip((cos - 0.15) / 0.2, 0, 1) if z is None else np.where(z > -50, 1 / (1 + np.exp(-np.maximum(z, -50))), 0)
            first = have["score"].to_numpy(dtype=np.float64)
            rel = 0.6 * p / (p.max() or 1) + 0.4 * first / (first.max() or 1)
            order = mmr_order(v, rel, diversity)
            ranked = have.iloc[order].assign(score=np.round(rel[order], 4))
            pdf = pd.concat([ranked, head[~head.index.isin(have.index)], tail])
        out = pdf[["query_id", "file_hash", "score"]].copy()
        out["position"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    rest = hits.drop("score", "position")
    return rows.groupBy("query_id").applyInPandas(reorder, schema).join(rest, ["query_id", "file_hash"])


def rerank_with_scores(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Re-order by an external judge's 0..1 scores (query_id, file_hash, rating); unscored hits follow in order."""
    joined = hits.join(scores.select("query_id", "file_hash", "rating"), ["query_id", "file_hash"], "left")
    order = [F.col("rating").desc_nulls_last(), F.when(F.col("rating").isNotNull(), -F.col("score")).asc(), F.asc("position")]
    w = W.partitionBy("query_id").orderBy(*order)
    return (
        joined.withColumn("_pos", F.row_number().over(w))
        .withColumn("match", F.when(F.col("rating").isNotNull(), external_label(F.col("rating"))).otherwise(F.col("match")))
        .withColumn("score", F.coalesce("rating", "score"))
        .withColumn("position", F.col("_pos"))
        .drop("_pos", "rating")
    )
