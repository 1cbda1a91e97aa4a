"""Exact top-k by inner product: no-random-access aggregation over lists sorted by component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written_count

#: Rows of a block of candidates and of a block of queries: what a task holds at a time.
BLOCK = 8_192

#: Queries whose bounds are held at a time.
BATCH = 128

#: Parts of the lists that are read before the bounds are looked at.
DEPTHS = (0.5, 0.75, 0.9)

#: At a depth, reading stops for a query if at most this many candidates (and k) can still qualify; their scores are then resolved.
BUFFER = 64


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; rows with a null or non-finite component, null vectors and null keys are left out."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"), whole.alias("_llm_whole")).where("_llm_whole and id is not null").drop("_llm_whole")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows, ties to the smaller id.

    Both frames are (id, v array<long>). Rows are dealt to blocks whose number comes from a count; every block of queries meets every
    block of candidates in one task, where the candidates' components are lists sorted once for all queries. Read in step, the
    lists give each candidate a lower and an upper bound for each query (`block_top`). Each block returns k rows a query, and a window
    with a group limit before its shuffle picks the k best.

    Only rows with as many components as the query's have a score. Rows repeated exactly count once; of different vectors
    under one id each is a candidate, and none is a candidate for a query of that id. No rows, no result.
    """
    held, n = written_count(vectors.distinct())
    asked, m = written_count(queries.distinct())
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    at = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    candidates = held.select("id", "v", F.size("v").alias("d"), at(blocks).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"))
    wanted = asked.select("id", "v", F.size("v").alias("d"), at(parts).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"))

    def meet(query: pd.DataFrame, candidate: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(candidate) or not len(query["v"].iloc[0]):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        qid, row, ids, score = block_top(query["id"].to_numpy(), np.stack(query["v"].to_numpy()), candidate["id"].to_numpy(), np.stack(candidate["v"].to_numpy()), k)
        return pd.DataFrame({"query_id": qid[row], "vec_id": ids, "score": score})

    met = wanted.groupBy("q", "c", "d").cogroup(candidates.groupBy("q", "c", "d")).applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which all inner products of the rows of a and b are exact (int64 wraps as a long does)."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, index of the query, candidate id, score): the k best of one block for each query.

    For each component the candidates form a list, read from its top for queries whose component is positive and from its bottom for
    the others. After depth d an unread entry is at most the list's value there, and at least its last: with h the value at depth d,
    max(x, h) bounds a component from above whether it was read or not, and x if read, else the minimum, from below. The bounds of
    all candidates are thus two products of query and bound matrices. A candidate whose upper bound is less than the k-th best lower
    bound can't qualify. A query stops when few others are left, whose scores are then resolved; at full depth bounds meet.
    """
    kind = exact_type(queries, vectors)
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], vectors[order].astype(kind)
    n, width = c.shape
    ranked = np.sort(c, axis=0)
    levels = []
    for depth in DEPTHS:
        d = min(n - 1, int(n * depth))
        high, low = ranked[n - 1 - d], ranked[d]
        upper = np.concatenate([np.maximum(c, high), np.minimum(c, low)], axis=1)
        lower = np.concatenate([np.where(c >= high, c, ranked[0]), np.where(c <= low, c, ranked[-1])], axis=1)
        levels.append((upper.T.copy(), lower.T.copy()))
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    if kind is np.int64:
        levels = []  # bounds don't hold where sums wrap
    for first in range(0, len(queries), BATCH):
        q = queries[first : first + BATCH].astype(kind)
        signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        own = ids[None, :] == query_ids[first : first + BATCH, None]
        left = np.arange(len(q))
        for upper, lower in levels:
            if not len(left) or n <= k + BUFFER:
                break
            least = signed[left] @ lower
            least[own[left]] = -np.inf
            bar = np.partition(least, n - k, axis=1)[:, n - k]
            can = (signed[left] @ upper >= bar[:, None]) & ~own[left]
            done = can.sum(axis=1) <= k + BUFFER
            for i in np.flatnonzero(done):
                some = np.flatnonzero(can[i])
                out.append((first + left[i], *_best(ids[some], c[some] @ q[left[i]], k)))
            left = left[~done]
        if len(left):
            scores = q[left] @ c.T
            for i, row in zip(left, scores, strict=True):
                some = np.flatnonzero(~own[i])
                if len(some) > k:
                    bar = np.partition(row[some], len(some) - k)[len(some) - k]
                    some = some[row[some] >= bar]
                out.append((first + i, *_best(ids[some], row[some], k)))
    rows = np.concatenate([np.full(len(x[1]), x[0]) for x in out]) if out else np.zeros(0, np.int64)
    found = [np.concatenate([x[j] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for j in (1, 2)]
    return query_ids, rows, *found


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


__all__ = ["block_top", "quantised", "top_k"]
