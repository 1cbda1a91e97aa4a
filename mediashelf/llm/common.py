"""What the operators of this subpackage share: words, byte-wise word spans, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashelf.session import cut_and_count, cut_lineage, shared_dir

#: A word is a longest run of bytes other than blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one step of a Python task works on (a longer single text is a step of its own).
STEP_BYTES = 1_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only (null counts as empty)."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without its columns of these names, whatever their case: results take the place of columns that clash."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def steps(values: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts as UTF-8) for runs of rows of at most `limit` bytes together; null counts as empty."""
    texts = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, [x or b"" for x in texts.slice(first, i - first).to_pylist()]
            first, held = i, 0
        held += n
    if len(texts) > first:
        yield first, [x or b"" for x in texts.slice(first).to_pylist()]


#: A-Z as a-z, digits and bytes of other alphabets kept, all else a blank.
PLAIN = np.full(256, 32, np.uint8)
PLAIN[128:] = np.arange(128, 256)
PLAIN[48:58] = np.arange(48, 58)
PLAIN[97:123] = PLAIN[65:91] = np.arange(97, 123)


class Words:
    """The words of some texts as spans of one byte array, read through a table of bytes, in which a blank parts the texts."""

    def __init__(self, texts: list[bytes], table: np.ndarray = LOWER):
        self.data = table[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        self.row_start = np.concatenate(([0], np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))))
        space = np.concatenate(([True], SPACE[self.data]))
        turns = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = turns[::2], turns[1::2]
        #: first_word[i]:first_word[i + 1] are the words of text i
        self.first_word = np.searchsorted(self.start, self.row_start)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first_word))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word."""
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        return mixed(h ^ (self.end - self.start).astype(np.uint64))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        n = max(n, STEP_BYTES + STEP_BYTES // 4)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sums_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last] (along axis 0) for each pair of bounds."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[last] - total[first]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge with the smallest node it can reach.

    Alternates two steps: every node hands its larger neighbours, then its smaller ones, to the smallest node it knows.
    The number of edges never grows and a few rounds suffice even for long chains. A node with very many edges is a
    minimum (combined before the shuffle) and one side of an equi-join, which Spark splits; no neighbour list is built.
    Each round's edges are written to the shared folder. Null nodes and loops take no part.
    """
    now, seen = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct()), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _written(low.select("u", F.col("m").alias("v")).union(small.where(F.col("u") != F.col("v"))).distinct())
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(mark)


def _written(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


def written_count(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """The frame as a table in the shared folder, and how many of its rows meet the condition (default: all)."""
    return cut_and_count(df, F.lit(True) if condition is None else condition)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, bucketed by a key like the shuffles that will meet it, and the table's name, for the caller to drop."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", shared_dir(spark, "bucketed")).option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    return spark.table(name), name
