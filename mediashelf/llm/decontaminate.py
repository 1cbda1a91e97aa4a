"""Benchmark decontamination: latent semantic retrieval of passages, then checks of word order and of the telling words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import PLAIN, Words, steps

#: Words of a passage and of the step to the next; a benchmark text is searched in parts of a passage.
PASSAGE, STRIDE = 64, 32

#: Words from one part of a long benchmark text to the next, and from one window in which a candidate is checked to the next: any PASSAGE
#: words of a text lack at most CHECK // 2 words of a window, so that 3 of its RAREST words are left.
STEP, CHECK = 16, 4

#: Words in a larger share of passages don't describe one, unless they are among the KEEP rarest of a part.
COMMON, KEEP = 0.02, 8

#: Directions of the latent space besides those of the benchmark, and columns drawn in excess to find them.
DIRECTIONS, EXCESS = 32, 8

#: A passage is a candidate for a part from this cosine on.
COSINE = 0.45

#: A candidate holds a part if so much of the part's words stands in it in order, and so many of its rarest words in it.
IN_ORDER, RAREST, TELLING = 0.7, 5, 0.6

#: Items that are searched in one pass over the documents; of parts, about 4 times as many.
BLOCK = 2_048


@dataclass
class Parts:
    """The parts of benchmark texts: their words as indices into the sorted hashes of all their words."""

    items: list
    words: list[np.ndarray]
    hashes: np.ndarray
    #: The windows of the text in which a part's candidates are checked: the part itself and those beginning near it.
    windows: list[list[np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]]) -> Parts:
        items, found, near = [], [], []
        for item, text in rows:
            h = Words([text], PLAIN).hashes()
            last = max(0, len(h) - PASSAGE)
            checks = sorted({*range(0, last, CHECK), last})
            for at in sorted({*range(0, last, STEP), last}) if len(h) else []:
                items.append(item)
                found.append(h[at : at + PASSAGE])
                near.append([h[c : c + PASSAGE] for c in sorted({at, *checks}) if abs(c - at) <= STEP // 2 + CHECK // 2])
        hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return cls(items, [np.searchsorted(hashes, f) for f in found], hashes, [[np.searchsorted(hashes, f) for f in fs] for fs in near])

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash, -1 if it is no word of a part; a table of 16 bits spares most of the search."""
        low = np.zeros(1 << 16, bool)
        low[self.hashes & np.uint64(0xFFFF)] = True
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(low[h & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == h[maybe]
        out[maybe[same]] = at[same]
        return out


@dataclass
class Space:
    """The latent space: idf of each word (0 if it doesn't describe), an orthonormal basis, the parts in it."""

    parts: Parts
    idf: np.ndarray
    basis: np.ndarray

    def part_vectors(self) -> np.ndarray:
        v = np.stack([np.bincount(w, minlength=len(self.idf)) * self.idf for w in self.parts.words]) @ self.basis
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def passages_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text of each half passage, half passage of each word): a passage is two neighbouring halves of STRIDE words."""
    lengths = np.diff(w.first_word)
    halves = -(-lengths // STRIDE)
    base = np.concatenate(([0], np.cumsum(halves)[:-1])).astype(np.int64) if len(halves) else np.zeros(0, np.int64)
    place = np.arange(len(w)) - w.first_word[:-1][w.row]
    return np.repeat(np.arange(len(lengths)), halves), base[w.row] + place // STRIDE


def passage_counts(docs: DataFrame, parts: Parts, text: str) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each word of the parts is, and how many passages there are."""
    ship = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = ship.value
        total, n = np.zeros(len(p.hashes), np.int64), 0
        for b in batches:
            for _, texts in steps(b.column(0)):
                w = Words(texts, PLAIN)
                halves, of = passages_of(w)
                term = p.look_up(w.hashes())
                at = term >= 0
                total += np.bincount(np.unique((of[at] // 2) * len(p.hashes) + term[at]) % len(p.hashes), minlength=len(p.hashes))
                n += -(-len(halves) // 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(n, total))], names=["at", "n"])

    found = docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(parts.hashes) + 1, np.int64)
    out[found["at"].to_numpy(int) + 1] = found["n"]
    return out[1:], int(out[0])


def weighted(w: Words, parts: Parts, idf: np.ndarray, telling: np.ndarray | None = None, need: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(all terms, text of each half, half and term of the words that describe, which halves begin a passage that can be a candidate).

    With `telling`, marks of terms, and `need`, how many of them a candidate's surroundings hold at least, only words of halves that
    belong to such passages are told: a passage's surroundings are half a passage to either side.
    """
    term = parts.look_up(w.hashes())
    halves, of = passages_of(w)
    describes, can = (term >= 0) & (idf[term] > 0), None
    if telling is not None:
        n = np.bincount(of[(term >= 0) & telling[term]], minlength=len(halves))
        total = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(len(halves))
        can = total[np.minimum(at + 3, len(halves))] - total[np.maximum(at - 1, 0)] >= need
        describes &= (can | np.append(False, can[:-1]))[of] if len(halves) else False
    at = np.flatnonzero(describes)
    return term, halves, of[at], term[at], can


def sketch(docs: DataFrame, parts: Parts, idf: np.ndarray, text: str, width: int, seed: int) -> np.ndarray:
    """A'A times a random matrix, A the matrix of all TF-IDF passages (rows of length one): each task adds up its own rows'.

    A task's sum has as many rows as the parts have words, so what is exchanged doesn't depend on the passages; sums of tasks are added in
    two rounds, blocks of rows apart, so that no task adds many.
    """
    omega = np.random.default_rng(seed).standard_normal((len(parts.hashes), width)).astype(np.float32)
    ship = docs.sparkSession.sparkContext.broadcast((parts, idf, omega))
    block = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, weight, draw = ship.value
        total, n = np.zeros(draw.shape, np.float64), len(p.hashes)
        for b in batches:
            for _, texts in steps(b.column(0)):
                _, _, half, term, _ = weighted(Words(texts, PLAIN), p, weight)
                if not len(term):
                    continue
                cell, tf = np.unique(half // 2 * n + term, return_counts=True)
                row, column, value = cell // n, cell % n, tf * weight[cell % n]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                length = np.sqrt(np.add.reduceat(value**2, first))
                value = value / np.repeat(length, np.diff(np.append(first, len(row))))
                z = np.add.reduceat(draw[column] * value[:, None].astype(np.float32), first, axis=0)
                by = np.argsort(column, kind="stable")
                starts = np.flatnonzero(np.diff(column[by], prepend=-1))
                which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))[by]
                total[column[by][starts]] += np.add.reduceat(z[which] * value[by][:, None].astype(np.float32), starts, axis=0)
        at = list(range(0, n, block))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[a : a + block].astype(np.float32).tobytes() for a in at], pa.binary())], names=["at", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(part, np.float32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["at", "part"])

    kind = "at long, part binary"
    own = docs.select(text).mapInArrow(run, kind)
    once = own.repartition(F.col("at"), F.spark_partition_id() % 16).mapInArrow(add, kind)
    found = once.repartition("at").mapInArrow(add, kind).collect()  # as many numbers as the parts have words, times width
    out = np.zeros(omega.shape)
    for row in found:
        part = np.frombuffer(row["part"], np.float32).reshape(-1, width)
        out[row["at"] : row["at"] + len(part)] += part
    return out


def latent_space(docs: DataFrame, parts: Parts, text: str = "text", seed: int = 17) -> Space:
    """The space in which passages and parts are compared.

    The matrix is that of all TF-IDF passages, the parts' own first: weighed so that they outweigh the documents' passages, whose
    leading directions come after them. Randomised SVD of such a matrix splits: the parts, a bounded set, are decomposed as they are; for
    the documents' passages one distributed product with a random matrix (`sketch`), made orthogonal to the parts' directions, gives their
    leading ones. Both are cut off where singular values vanish.
    """
    counts, n = passage_counts(docs, parts, text)
    idf = np.log((n + 1) / (counts + 1)) + 1e-3
    describes = counts <= COMMON * n
    for w in parts.words:
        rare = np.unique(w)
        describes[rare[np.argsort(counts[rare], kind="stable")[:KEEP]]] = True
    idf = np.where(describes, idf, 0.0)
    rows = np.stack([np.bincount(w, minlength=len(idf)) * idf for w in parts.words])
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    _, size, own = np.linalg.svd(rows, full_matrices=False)
    own = own[size > 1e-6 * max(size.max(initial=0), 1e-9)]
    y = sketch(docs, parts, idf, text, DIRECTIONS + EXCESS, seed)
    y -= own.T @ (own @ y)
    left, size, _ = np.linalg.svd(y, full_matrices=False)
    more = left[:, :DIRECTIONS][:, size[:DIRECTIONS] > 1e-6 * max(size.max(initial=0), 1e-9)]
    return Space(parts, idf.astype(np.float32), np.concatenate([own.T, more], axis=1).astype(np.float32))


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of one number per entry of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def held_parts(texts: list[bytes], space: Space, vectors: np.ndarray, rarest: list[list[np.ndarray]]) -> list[tuple[int, int, float, float]]:
    """(text, part, cosine, share in order) of the parts that the texts hold; rarest: of each window of each part."""
    parts = space.parts
    w = Words(texts, PLAIN)
    # a candidate needs TELLING of a window's rarest words around it: without so many of such words it needn't be projected
    telling = np.zeros(len(space.idf) + 1, bool)
    telling[np.unique(np.concatenate([x for near in rarest for x in near]))] = True
    need = min(math.ceil(TELLING * len(x) - 1e-9) for near in rarest for x in near)
    term, halves, half, words, can = weighted(w, parts, space.idf, telling, need)
    if not len(words):
        return []
    z = np.zeros((len(halves) + 1, space.basis.shape[1]), np.float32)
    first = np.flatnonzero(np.diff(half, prepend=-1))
    for a in range(0, len(first), 2_048):  # some words at a time
        low, high = first[a], first[a + 2_048] if a + 2_048 < len(first) else len(half)
        z[half[first[a : a + 2_048]]] = np.add.reduceat(space.basis[words[low:high]] * space.idf[words[low:high], None], first[a : a + 2_048] - low, axis=0)
    joined = np.append(halves[1:] == halves[:-1], False) if len(halves) else np.zeros(0, bool)
    passage = z[:-1] + z[1:] * joined[:, None]
    length = np.linalg.norm(passage, axis=1)
    some = np.flatnonzero((length > 0) & can)
    best: dict[tuple[int, int], tuple[float, float]] = {}
    base = np.searchsorted(halves, np.arange(len(texts)))
    for a in range(0, len(some), 4_096):
        at = some[a : a + 4_096]
        cosine = (passage[at] / length[at, None]) @ vectors.T
        for r, p in zip(*np.nonzero(cosine >= COSINE), strict=True):
            text = halves[at[r]]
            start = w.first_word[text] + (at[r] - base[text]) * STRIDE
            own = parts.words[p]
            low = max(w.first_word[text], start - len(own) // 2)
            high = min(w.first_word[text + 1], start + PASSAGE + len(own) // 2)
            region = term[low:high]
            told = [x for x, rare in zip(parts.windows[p], rarest[p], strict=True) if np.isin(rare, region).mean() >= TELLING]
            share = max((longest_common(x, region[region >= 0]) / len(x) for x in told), default=0.0)
            if share >= IN_ORDER:
                key = (int(text), int(p))
                best[key] = max(best.get(key, (0.0, 0.0)), (share, float(cosine[r, p])))
    return [(t, p, cosine, share) for (t, p), (share, cosine) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, cosine, in_order): the benchmark texts that documents hold, in whole or in any PASSAGE words in a row, also reworded.

    A text longer than PASSAGE words is searched in parts that begin every STEP words.

    Candidates are passages near a part in the latent space; a candidate holds the part if IN_ORDER of the part's words stand around it
    in order (longest common subsequence) and TELLING of its RAREST rarest words, which carry the answer, are there. Every passage
    of every document is compared with every part, in blocks; documents aren't exchanged. The benchmark is read in blocks of
    items of which each is one pass, so no more than a block's parts are ever shipped.

    Null and empty documents hold nothing; null, empty or wordless benchmark texts are held by none; rows with a null key are reported
    under null; repeated rows count once, with the highest values; an empty benchmark or no documents give no rows; other columns play no part.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("_llm_key"), F.col(text).alias("_llm_text"))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("_llm_item"), F.col(item_text).cast("binary").alias("_llm_body"))
    words = F.regexp_count(F.col("_llm_body").cast("string"), F.lit("[A-Za-z0-9\\x{80}-\\x{10FFFF}]+"))
    n, parts = items.agg(F.count("*"), F.sum(2 + F.greatest(words - PASSAGE, F.lit(0)) / STEP)).head()
    blocks = max(1, -(-n // BLOCK), math.ceil((parts or 0) / (4 * BLOCK)))
    kind = items.select(F.col("_llm_item").alias(item)).schema
    schema = source.select(F.col("_llm_key").alias(key)).withColumns({item: F.lit(None).cast(kind[0].dataType), "cosine": F.lit(0.0), "in_order": F.lit(0.0)}).schema
    item_kind = to_arrow_type(kind[0].dataType)
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("_llm_item", "_llm_body"), F.lit(blocks)) == k).collect()
        parts = Parts.of(sorted(((r["_llm_item"], bytes(r["_llm_body"])) for r in rows), key=str))
        if not parts.items:
            continue
        space = latent_space(source, parts, "_llm_text")
        ship = spark.sparkContext.broadcast(space)

        def run(batches: Iterator[pa.RecordBatch], ship=ship) -> Iterator[pa.RecordBatch]:
            s = ship.value
            vectors, idf = s.part_vectors(), s.idf
            rarest = [[np.unique(w)[np.argsort(-idf[np.unique(w)], kind="stable")[:RAREST]] for w in near] for near in s.parts.windows]
            for b in batches:
                for first, texts in steps(b.column(1)):
                    found = held_parts(texts, s, vectors, rarest)
                    if found:
                        t, p, cosine, share = zip(*found, strict=True)
                        keys = b.column(0).take(pa.array([first + i for i in t]))
                        yield pa.RecordBatch.from_arrays([keys, pa.array([s.parts.items[i] for i in p], item_kind), pa.array(cosine), pa.array(share)], names=schema.names)

        found = source.mapInArrow(run, schema).groupBy(key, item).agg(F.max("cosine").alias("cosine"), F.max("in_order").alias("in_order"))
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark text, with all their columns; rows with a null key stay."""
    gone = contaminated(docs, benchmark, key, text, item, item_text).select(F.col(key).alias("_llm_gone")).where("_llm_gone is not null").distinct()
    return docs.join(gone, F.col(key) == F.col("_llm_gone"), "left_anti")


__all__ = ["Parts", "Space", "clean", "contaminated", "held_parts", "longest_common"]
