"""Keyword search: BM25 over weighted fields, statistics per user.

score = sum over query terms of idf * tf' / (k1 + tf'),  tf' = sum over fields of boost * tf / (1 - b + b * len / avg len),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)). N, df and average lengths are the user's, whatever the allow-list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import BM25_B, BM25_K1
from ..functions.text import split_at_blanks, tokens
from .library import top_k

#: Terms of a query batch, one row per query and term, up to which they and their statistics are joined by a broadcast.
BATCH_TERMS = 200_000

TITLE_AND_TEXT = {"title": 2.0, "text": 1.0}
TAGS_AND_TEXT = {"tags": 2.0, "search_text": 1.0}


def _field_tokens(docs: DataFrame, field: str) -> Column:
    c = F.col(field)
    if docs.schema[field].dataType.typeName() == "array":
        c = F.array_join(c, " ")
    return tokens(F.coalesce(c, F.lit("")))


def tokenize(docs: DataFrame, fields: dict[str, float], keys: list[str], by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """keys + one token array per field, named _t0, _t1... in field order; the rows of a document are together.

    `keys`: those of `by`, then the document's. The tokens are shuffled once, as they stand in the text. All that follows is grouped by document
    and needs no shuffle of its own; statistics, frequencies and weights read the same shuffle.
    """
    words = docs.select(*keys, *[F.array_join(_field_tokens(docs, f), " ").alias(f"_w{i}") for i, f in enumerate(fields)])
    return words.repartition(*keys[: len(by) + 1]).select(*keys, *[split_at_blanks(F.col(f"_w{i}")).alias(f"_t{i}") for i in range(len(fields))])


def field_stats(tokenized: DataFrame, by: list[str], n_fields: int) -> DataFrame:
    """Per user: number of documents and average length of each field."""
    lengths = [F.avg(F.size(f"_t{i}")).alias(f"avg_len{i}") for i in range(n_fields)]
    return tokenized.groupBy(*by).agg(F.count("*").alias("n_docs"), *lengths)


def postings(tokenized: DataFrame, keys: list[str], n_fields: int, vocabulary: DataFrame | None = None, by=("user_id",)) -> DataFrame:
    """Term frequencies and field lengths per (term, document). With a vocabulary (user_id, term), other tokens are dropped."""
    lengths = [F.size(f"_t{i}").alias(f"len{i}") for i in range(n_fields)]

    def tagged(i: int) -> Column:
        return F.transform(f"_t{i}", lambda t: F.struct(F.lit(i).alias("f"), t.alias("term")))

    rows = tokenized.select(*keys, *lengths, F.inline(F.concat(*[tagged(i) for i in range(n_fields)])))
    if vocabulary is not None:
        rows = rows.join(vocabulary, [*by, "term"], "left_semi")
    tf = [F.count(F.when(F.col("f") == i, 1)).alias(f"tf{i}") for i in range(n_fields)]
    return rows.groupBy(*dict.fromkeys([*keys, "term"]), *[f"len{i}" for i in range(n_fields)]).agg(*tf)


def bm25_index(docs: DataFrame, fields: dict[str, float], keys: list[str], by: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics per user, document frequency per term, postings) of a whole collection."""
    by = by or ["user_id"]
    t = tokenize(docs, fields, keys, tuple(by))
    p = postings(t, keys, len(fields), by=tuple(by))
    return field_stats(t, by, len(fields)), p.groupBy(*by, "term").agg(F.count("*").alias("df")), p


def term_weights(p: DataFrame, known: DataFrame, fields: dict[str, float], by: list[str], k1: float, b: float) -> DataFrame:
    """Postings with the weight each term contributes to a document's score. `known`: df of each term with its user's statistics."""
    weight = F.lit(0.0)
    for i, boost in enumerate(fields.values()):
        relative = F.col(f"len{i}") / F.nullif(F.col(f"avg_len{i}"), F.lit(0.0))
        weight = weight + boost * F.col(f"tf{i}") / (1 - b + b * F.coalesce(relative, F.lit(1.0)))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    joined = p.join(known, [*by, "term"])
    return joined.withColumn("_tf", weight).withColumn("weight", idf * F.col("_tf") / (k1 + F.col("_tf")))


def bm25_search(
    queries: DataFrame,
    docs: DataFrame | tuple[DataFrame, DataFrame, DataFrame],
    fields: dict[str, float],
    keys: list[str],
    n: int | None = None,
    allow: DataFrame | None = None,
    by: list[str] | None = None,
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """(query_id, *keys, bm25) of the documents sharing a term with each query, the n best if asked.

    `queries`: query_id, user_id, keywords, and `filtered` with an `allow` list. A batch of up to BATCH_TERMS terms, counted, is shipped with
    its statistics, so that documents move once (`tokenize`); larger ones are equi-joins, whose hot (user, term) keys are left to AQE's skew
    splitting. `docs` may also be the three tables of `bm25_index`, written once: a batch then reads its own terms' rows and no texts.
    """
    from .library import within

    by = by or ["user_id"]
    keys = list(dict.fromkeys([*by, *keys]))
    out_keys = [c for c in keys if c not in by]
    terms = queries.select("query_id", *by, F.explode(F.array_distinct(tokens(F.col("keywords")))).alias("term"))
    shipped = F.broadcast if terms.limit(BATCH_TERMS + 1).count() <= BATCH_TERMS else (lambda table: table)
    vocabulary = shipped(terms.select(*by, "term").distinct())
    if isinstance(docs, tuple):
        stats, df, p = docs
        df, p = (x.join(vocabulary, [*by, "term"], "left_semi") for x in (df, p))
    else:
        t = tokenize(docs, fields, keys, tuple(by))
        p = postings(t, keys, len(fields), vocabulary, tuple(by))
        df, stats = p.groupBy(*by, "term").agg(F.count("*").alias("df")), field_stats(t, by, len(fields))
    weights = term_weights(p, shipped(df.join(stats, by)), fields, by, k1, b)
    pairs = weights.select(*keys, "term", "weight").join(shipped(terms), [*by, "term"])
    hits = pairs.groupBy("query_id", *by, *out_keys).agg(F.round(F.sum("weight"), 9).alias("bm25"))
    if allow is not None:
        hits = within(hits, queries, allow)
    if n is None:
        return hits
    return top_k(hits, ["query_id"], [F.desc("bm25"), *[F.asc(c) for c in out_keys]], n)
