"""Exact and approximate nearest vectors, zero-shot labels, mean vectors.

Vectors of one user and one embedding model form a space; spaces never mix. The index is split into blocks of
bounded size (a busy user gets many), each block is scored against its queries by one matrix product, and only
n rows per query leave a block. Query-vector pairs are never materialised as rows.

Similarities are rounded to nine decimals, so that equal vectors tie exactly (and break by file_hash) however the
work was split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import SMALL_BATCH, collect_small, cut_lineage
from .library import top_k

SPACE = ["user_id", "embed_model"]
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 256
SLICE = 256
DECIMALS = 9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _best(sims: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best of one row of similarities (-inf = not a candidate), ties by id."""
    if len(sims) > n:
        cut = np.partition(sims, len(sims) - n)[len(sims) - n]
        keep = np.flatnonzero((sims >= cut) & (sims > -np.inf))
    else:
        keep = np.flatnonzero(sims > -np.inf)
    return keep[np.lexsort((ids[keep], -sims[keep]))[:n]]


def block_top_n(
    q: pd.DataFrame, x: pd.DataFrame, n: int, qid: str, xid: str, extra: tuple[str, ...] = ()
) -> pd.DataFrame:
    """Top n rows of block x for every query of block q, a few hundred queries per matrix product.

    Optional columns: q.filtered with x.allowed (ids of filtering queries that admit the row), q.seq with
    x.seen_from and x.seen_to (row visible to queries with seen_from < seq < seen_to).
    """
    vectors, ids = _matrix(x["embedding"]).T, x[xid].to_numpy()
    parts = [_slice_top_n(q.iloc[i : i + SLICE], x, vectors, ids, n, qid) for i in range(0, len(q), SLICE)]
    at, who, cos = (np.concatenate(p) for p in zip(*parts, strict=True))
    return pd.DataFrame({qid: who, xid: ids[at], "cos": cos} | {c: x[c].to_numpy()[at] for c in extra})


def _slice_top_n(q: pd.DataFrame, x: pd.DataFrame, vectors: np.ndarray, ids: np.ndarray, n: int, qid: str) -> tuple:
    sims = np.round(_matrix(q["embedding"]) @ vectors, DECIMALS)
    if "filtered" in q and "allowed" in x:
        ok = np.repeat(~q["filtered"].to_numpy(dtype=bool)[:, None], len(x), axis=1)
        lists = [() if v is None else v for v in x["allowed"]]
        rows = pd.Index(q[qid]).get_indexer(np.concatenate(lists)) if any(map(len, lists)) else np.array([], dtype=int)
        cols = np.repeat(np.arange(len(x)), [len(v) for v in lists])
        ok[rows[rows >= 0], cols[rows >= 0]] = True
        sims = np.where(ok, sims, -np.inf)
    if "seq" in q:
        seq = q["seq"].to_numpy()[:, None]
        seen = (x["seen_from"].to_numpy()[None, :] < seq) & (seq < x["seen_to"].to_numpy()[None, :])
        sims = np.where(seen, sims, -np.inf)
    hits = [_best(row, ids, n) for row in sims]
    at = np.concatenate(hits)
    who = np.repeat(np.arange(len(q)), [len(h) for h in hits])
    return at, q[qid].to_numpy()[who], sims[who, at]


def search_blocks(
    queries: DataFrame,
    index: DataFrame,
    n: int,
    space: list[str],
    qid: str = "query_id",
    xid: str = "file_hash",
    allow: DataFrame | None = None,
    extra: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Per-block top n of every query, by cogrouping query blocks with index blocks of the same space.

    Block numbers come from counted sizes: no group holds more than about block_rows vectors, whoever owns them.
    """
    n_rows = index.groupBy(*space).agg(F.count("*").alias("_n"))
    n_queries = queries.groupBy(*space).agg(F.count("*").alias("_q"))
    sizes = n_rows.join(n_queries, space).select(
        *space,
        F.ceil(F.col("_n") / block_rows).cast("int").alias("_xb"),
        F.ceil(F.col("_q") / block_queries).cast("int").alias("_qb"),
    )
    qblock = F.pmod(F.xxhash64(qid), F.col("_qb")).cast("int")
    q = queries.join(sizes, space).withColumn("_qblock", qblock)
    x = index.join(sizes, space).withColumn("_xblock", F.pmod(F.xxhash64(xid), F.col("_xb")).cast("int"))
    x = x.withColumn("_qblock", F.explode(F.sequence(F.lit(0), F.col("_qb") - 1)))
    if allow is not None:
        # admitted queries as one short array per (row, query block)
        by_row = allow.select(qid, xid).join(q.select(qid, *space, "_qblock"), qid)
        by_row = by_row.groupBy(*space, xid, "_qblock").agg(F.collect_set(qid).alias("allowed"))
        x = x.join(by_row, [*space, xid, "_qblock"], "left")
    q = q.withColumn("_xblock", F.explode(F.sequence(F.lit(0), F.col("_xb") - 1)))
    key = [*space, "_qblock", "_xblock"]
    types = {f.name: f.dataType.simpleString() for f in index.schema}
    schema = f"{qid} {queries.schema[qid].dataType.simpleString()}, {xid} {types[xid]}, cos double"
    schema += "".join(f", {c} {types[c]}" for c in extra)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[qid, xid, "cos", *extra])
        return block_top_n(left, right, n, qid, xid, extra)

    q_cols = [c for c in (qid, "embedding", "filtered", "seq") if c in q.columns]
    x_cols = [c for c in dict.fromkeys([xid, "embedding", "allowed", "seen_from", "seen_to", *extra]) if c in x.columns]
    return (
        q.select(*key, *q_cols)
        .groupBy(*key)
        .cogroup(x.select(*key, *x_cols).groupBy(*key))
        .applyInPandas(lambda a, b: score(a, b), schema)
    )


def scan_blocks(
    batch: list, qid_type: str, index: DataFrame, n: int, space: list[str], allow: DataFrame | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Per-partition top n for a small, already collected query batch: the index is scanned where it lies.

    An allow-list joins the index as one short array of admitting queries per file.
    """
    asked = pd.DataFrame([r.asDict() for r in batch])
    types = {f.name: f.dataType.simpleString() for f in index.schema}
    schema = f"query_id {qid_type}, file_hash {types['file_hash']}, cos double"
    schema += "".join(f", {c} {types[c]}" for c in extra)
    shared = index.sparkSession.sparkContext.broadcast({k: g for k, g in asked.groupby(space)})

    def scan(batches):
        best = None
        for pdf in batches:
            found = [
                block_top_n(shared.value[k], g, n, "query_id", "file_hash", extra)
                for k, g in pdf.groupby(space)
                if k in shared.value
            ]
            if not found:
                continue
            pool = pd.concat(([] if best is None else [best]) + found, ignore_index=True)
            pool = pool.sort_values(["query_id", "cos", "file_hash"], ascending=[True, False, True])
            best = pool.groupby("query_id").head(n)
        if best is not None:
            yield best

    users = sorted({r[space[0]] for r in batch})
    wanted = index.filter(F.col(space[0]).isin(users)) if len(users) <= 100 else index
    columns = dict.fromkeys([*space, "file_hash", "embedding", *extra])
    if allow is not None:
        admitted = allow.groupBy("file_hash").agg(F.collect_set("query_id").alias("allowed"))
        wanted = wanted.join(admitted, "file_hash", "left")
        columns["allowed"] = None
    return wanted.select(*columns).mapInPandas(scan, schema)


def vector_search(
    queries: DataFrame,
    index: DataFrame,
    n: int,
    allow: DataFrame | None = None,
    extra: tuple[str, ...] = (),
    space: list[str] | None = None,
    small_batch: int = SMALL_BATCH,
) -> DataFrame:
    """The n nearest index vectors of each query within its user and model: (query_id, file_hash, cos, rank).

    `queries`: query_id, user_id, embed_model, embedding (unit vectors); with an `allow` list (query_id, file_hash)
    also `filtered`, true for queries it restricts - before ranking, so a filtered query still gets n hits.
    A batch of at most `small_batch` queries is shipped to the index partitions; a larger one is shuffled by blocks.
    """
    space = space or SPACE
    batch = None
    if small_batch:
        asked = [c for c in ("query_id", *space, "embedding", "filtered") if c in queries.columns]
        batch = collect_small(queries.select(*asked), small_batch)
    if batch:
        partial = scan_blocks(batch, queries.schema["query_id"].dataType.simpleString(), index, n, space, allow, extra)
    else:
        partial = search_blocks(queries, index, n, space, allow=allow, extra=extra)
    return top_k(partial, ["query_id"], [F.desc("cos"), F.asc("file_hash")], n, rank="rank")


def vector_search_approx(
    queries: DataFrame, index: DataFrame, n: int, tables: int = 10, bits: int = 6, radius: int = 2, seed: int = 7
) -> DataFrame:
    """Approximate search by random-hyperplane hashing; same output as `vector_search`.

    A vector's bucket in each table is the sign pattern of `bits` random projections. A query also probes the buckets whose
    pattern differs in up to `radius` signs: even neighbours at a cosine of 0.4 are then found with a probability of about
    0.99, closer ones more surely. Buckets become part of the block key of the exact search, so a full bucket is split like any
    other busy group. Queries left with fewer than n hits are searched exactly, so none gets fewer than there are.
    """
    dim_row = index.select(F.size("embedding").alias("d")).head()
    if dim_row is None:
        return vector_search(queries, index, n)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim_row.d))
    powers = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def buckets(v: pd.Series) -> pd.Series:
        signs = np.einsum("tbd,nd->ntb", planes, _matrix(v)) > 0
        return pd.Series(list((signs * powers).sum(axis=2).astype(np.int32)))

    def hashed(df: DataFrame, *cols: str) -> DataFrame:
        return df.select(*cols, *SPACE, "embedding", F.posexplode(buckets("embedding")).alias("_table", "_bucket"))

    flips = F.array(*(F.lit(m) for m in range(1 << bits) if m.bit_count() <= radius))
    q, x = hashed(queries, "query_id"), hashed(index, "file_hash")
    q = q.withColumn("_flip", F.explode(flips)).withColumn("_bucket", F.col("_bucket").bitwiseXOR(F.col("_flip"))).drop("_flip")
    found = search_blocks(q, x, n, [*SPACE, "_table", "_bucket"])
    once = cut_lineage(found.groupBy("query_id", "file_hash").agg(F.max("cos").alias("cos")))
    served = once.groupBy("query_id").agg(F.count("*").alias("_hits")).filter(F.col("_hits") >= n)
    short = queries.join(served, "query_id", "left_anti")
    best = top_k(once.join(served.select("query_id"), "query_id", "left_semi"), ["query_id"], [F.desc("cos"), F.asc("file_hash")], n, rank="rank")
    return best.unionByName(vector_search(short, index, n))


def lookup_vectors(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Stored vectors of (user_id, embed_model, file_hash) keys; unknown keys give nothing."""
    return index.join(keys.select(*SPACE, "file_hash").distinct(), [*SPACE, "file_hash"], "left_semi")


# ---------------------------------------------------------------- means and labels
def mean_vectors(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Normalised mean vector per group, summed dimension by dimension (combines before the shuffle)."""
    dims = vectors.select(*by, F.posexplode(vector).alias("_d", "_v"))
    mean = dims.groupBy(*by, "_d").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    packed = mean.groupBy(*by).agg(
        F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_norm"),
        F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_mean"),
    )
    length = F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(F.lit(1.0))
    unit = F.zip_with("_mean", F.array_repeat(length, F.size("_mean")), lambda x, s: x / s)
    return packed.select(*by, unit.alias(vector))


def label_prototypes(template_vectors: DataFrame) -> DataFrame:
    """One vector per label: the normalised mean of its prompt templates' vectors. Input: grp, name, embedding."""
    return mean_vectors(template_vectors, ["grp", "name"])


MAX_LABELS = 5_000


def classify(
    images: DataFrame, labels: DataFrame, scale: float, bias: float | None = None, min_prob: float = 0.08, max_tags: int = 8
) -> DataFrame:
    """Adds kind (nearest label of group 'kind'), kind_probs (map) and tags (label, score; best first).

    The vocabulary is a model constant of a few hundred labels; its size is checked before it is shipped.
    """
    rows = collect_small(labels.select("grp", "name", "embedding"), MAX_LABELS)
    if not rows:
        raise ValueError(f"need between 1 and {MAX_LABELS} labels")
    # ties go to the name that sorts first
    kinds = sorted((r.name, r.embedding) for r in rows if r.grp == "kind")
    tags = sorted((r.name, r.embedding) for r in rows if r.grp == "tag")
    kind_m, tag_m = (np.array([v for _, v in group], dtype=np.float64) for group in (kinds, tags))
    kind_names, tag_names = ([k for k, _ in group] for group in (kinds, tags))

    def prob(cos: np.ndarray) -> np.ndarray:
        if bias is None:
            return np.clip((cos - 0.15) / 0.2, 0, 1)
        z = scale * cos + bias
        return np.where(z > -50, 1 / (1 + np.exp(-np.clip(z, -50, None))), 0.0)

    @F.pandas_udf("kind string, kind_probs map<string,double>, tags array<struct<label:string,score:double>>")
    def label(v: pd.Series) -> pd.DataFrame:
        x = _matrix(v)
        kc, tc = np.round(x @ kind_m.T, DECIMALS), np.round(x @ tag_m.T, DECIMALS)
        tp = prob(tc)
        picked = []
        for cos, p in zip(tc, tp, strict=True):
            top = np.argsort(-cos, kind="stable")[:max_tags]
            picked.append([{"label": tag_names[j], "score": round(float(p[j]), 3)} for j in top if p[j] >= min_prob])
        kinds_ = [kind_names[j] for j in kc.argmax(axis=1)]
        probs = [dict(zip(kind_names, row, strict=True)) for row in prob(kc).tolist()]
        return pd.DataFrame({"kind": kinds_, "kind_probs": probs, "tags": picked})

    return images.withColumn("_l", label("embedding")).select(*images.drop("kind", "tags").columns, "_l.*")


def refine_kind(kind: Column, kind_probs: Column, camera: Column, software: Column, filename: Column) -> Column:
    """Metadata as evidence: a screenshot says so; a camera photo is one unless the classifier is confident."""
    name, soft = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(software, F.lit("")))
    shot = F.contains(name, F.lit("screenshot")) | F.contains(soft, F.lit("screenshot")) | F.contains(name, F.lit("screen shot"))

    def sure(label: str) -> Column:
        return F.coalesce(F.try_element_at(kind_probs, F.lit(label)), F.lit(0.0)) >= 0.3

    shot_by_camera = F.coalesce(camera, F.lit("")) != ""
    return (
        F.when(shot, "screenshot")
        .when(shot_by_camera & sure("receipt"), "receipt")
        .when(shot_by_camera & sure("document"), "document")
        .when(shot_by_camera, "photo")
        .otherwise(kind)
    )
