"""Suffix-array dedup: bytes covered by long strings that also start elsewhere, found by run-length indexes of small blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.session import cut_lineage

from .common import bucketed, mixed, written_count

#: Bytes of the strings that mustn't repeat.
LENGTH = 200

#: Bytes of the anchors in them.
ANCHOR = 64

#: Rounds of cutting by anchors; what still meets too often is then cut to single strings.
ROUNDS = 3

#: Bytes of different pieces that may share an anchor, and bytes of a block that is indexed at once.
BLOCK_BYTES = 750_000

#: Starts of strings looked at together in one long text, and in one piece.
LONG, PIECE = 1_000_000, 1_024

RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def hashes(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on."""
    width, out, at = 1, mixed((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)), 0
    powers, whole = out, None
    for bit in range(k.bit_length()):  # doubling: widths 1, 2, 4, ... and their sum
        if k >> bit & 1:
            if whole is None:
                whole, at = powers, width
            else:
                n = len(powers) - at
                whole = whole[:n] * np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64)) + powers[at : at + n]
                at += width
        if k >> (bit + 1):
            n = len(powers) - width
            powers = powers[:n] * np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64)) + powers[width:]
            width *= 2
    return mixed(whole)


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or, by `pick`, greatest) of each `width` neighbours."""
    p = 1
    while p * 2 <= width:
        values, p = pick(values[:-p], values[p:]), p * 2
    rest = width - p
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def parts(body: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, bytes) of stretches that together have every string of `length` bytes, each once."""
    data = np.frombuffer(body, np.uint8)
    for at in range(0, len(data) - length + 1, LONG):
        yield at, data[at : at + LONG + length - 1]


def anchors(body: bytes, length: int, k: int, seed: int) -> np.ndarray:
    """The anchors of a text: hashes that are the least in some string of `length` bytes; one that is so at two places stands twice."""
    out = []
    for _, data in parts(body, length):
        h, width = hashes(data, k, seed), length - k + 1
        least = sliding(h, width)
        pad = np.zeros(width - 1, np.uint64)
        value, n = np.unique(h[h == sliding(np.concatenate([pad, least, pad]), width, np.maximum)], return_counts=True)
        out.append(np.repeat(value, np.minimum(n, 2)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def pieces(body: bytes, wanted: np.ndarray, length: int, k: int, seed: int, most: int = PIECE) -> Iterator[tuple[int, int, int, bool]]:
    """(first string, number of strings, anchor, whether it stands there twice) of runs of neighbouring strings that have one anchor, if it is wanted."""
    wanted = np.sort(wanted)
    for at, data in parts(body, length):
        h, width = hashes(data, k, seed).view(np.int64), length - k + 1
        least = sliding(h.view(np.uint64), width).view(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        value, n = least[cut], np.diff(np.append(cut, len(least)))
        found = wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value if len(wanted) else np.zeros(len(cut), bool)
        for s, m, v in zip(cut[found].tolist(), n[found].tolist(), value[found].tolist(), strict=True):
            for first in range(s, s + m, most):
                some = min(most, s + m - first)
                yield at + first, some, v, bool(np.count_nonzero(h[first : first + some + width - 1] == v) > 1)


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of some texts, with the suffix-array entries sampled at its runs' ends.

    Suffixes are sorted by doubling; a text ends in a symbol of its own, so no match crosses texts. Of the transform only runs are
    kept: for each run's first suffix its place and that of the suffix before it (the end of the run before), both sampled, and how much
    the two share. Between samples, in text order, the place before moves along and the shared length falls by one, so these are the
    matching statistics of the texts against themselves, the trivial match left out: as many numbers as runs, few if texts repeat.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.start = np.concatenate(([0], np.cumsum(sizes + 1)))
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        n = len(data)
        last = self.start[1:] - 1
        data[last] = 0
        self.left = np.repeat(last, sizes + 1) - np.arange(n)  # symbols before the text ends
        padded = np.concatenate([data, np.zeros(6, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = key << 9 | np.where(self.left > i, padded[i : i + n], 0)
        order = np.argsort(key, kind="stable")
        rank = self._ranks(key, order)
        width = 7
        while width < self.left.max() and rank.max() < n - 1:
            more = np.where(self.left > width, rank[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
            pair = rank * (n + 1) + more
            order = np.argsort(pair, kind="stable")
            rank = self._ranks(pair, order)
            width *= 2
        before = np.where(order > 0, data[order - 1], 0)
        head = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
        head[0] = False  # nothing before the first suffix
        at = np.flatnonzero(head)
        samples = np.argsort(order[at])
        self.sample, self.before = order[at][samples], order[at - 1][samples]
        self.shared = self._shared(key, self.sample, self.before)
        self.stop = np.append(self.sample[1:], n)

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        by = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(by[1:] != by[:-1])))
        return rank

    def _shared(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, seven at a time."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            other = key[x] ^ key[y]
            same = np.minimum(np.minimum(self.left[x], self.left[y]), 7)
            for i in range(7):
                same = np.where(other >> (9 * (6 - i)) == 0, same, np.minimum(same, i))
            out[live] += same
            live = live[same == 7]
        return out

    def repeats(self, length: int) -> list[list[tuple[int, int]]]:
        """For each text the [first, end) of starts of strings of `length` symbols that also start elsewhere; ranges may overlap."""
        n = np.minimum(self.shared - length + 1, self.stop - self.sample)
        at = np.flatnonzero(n > 0)
        first = np.concatenate([self.sample[at], self.before[at]])
        n = np.concatenate([n[at], n[at]])
        text = np.searchsorted(self.start, first, side="right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(self.start) - 1)]
        for t, f, m in zip(text.tolist(), (first - self.start[text]).tolist(), n.tolist(), strict=True):
            out[t].append((f, f + m))
        return out


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as ranges that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _ranges(values: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for v in values for x in v]
    a, b = zip(*flat, strict=True) if flat else ((), ())
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]))


def repeated(texts: DataFrame, length: int = LENGTH, done: int = 0) -> DataFrame:
    """(key, ranges array<struct<a, b>>): starts of strings of `length` bytes that start at two places of the texts (key, body binary), each text once.

    1. Each string has an anchor, the least hash of its stretches of ANCHOR bytes; equal strings have equal anchors. Anchors met once,
       nearly all, can't belong to a repeated string: they are counted and the rest return to their texts.
    2. Texts are cut into pieces, runs of strings with one such anchor. Equal pieces are counted, not listed: all
       their strings repeat.
    3. Different pieces with one anchor (and pieces where it stands twice) are indexed together, in blocks of bounded size, by a RunLengthIndex.
    4. An anchor with more bytes of pieces than a block holds is cut anew by another hash, and in the last round to single strings, which
       leaves nothing to index: no anchor's pieces ever have to meet in one task.
    """
    k, seed, most = (ANCHOR, 101 + done, PIECE) if done < ROUNDS else (length, 0, 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(x.as_py(), length, k, seed) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "vs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, body, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                body = body.as_py()
                for s, n, v, twice in pieces(body, wanted.values.to_numpy(), length, k, seed, most):
                    rows.append((key, s, n, v, twice, hashlib.blake2b(body[s : s + n + length - 1], digest_size=16).digest()))
                    if len(rows) >= 20_000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body, asked in zip(*b.columns, strict=True):
                body, rows = body.as_py(), asked.as_py()
                bodies = [body[r["s"] : r["s"] + r["n"] + length - 1] for r in rows]
                columns = [pa.array([r[c] for r in rows], t) for c, t in (("v", pa.int64()), ("piece", pa.binary()), ("large", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary())], names=["v", "piece", "large", "body"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size, anchor = 0, None
        for b in batches:
            for v, piece, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if v != anchor and size >= BLOCK_BYTES:
                    yield _indexed(held, length)
                    held, size = [], 0
                anchor, size = v, size + len(body)
                held.append((piece, body))
        if held:
            yield _indexed(held, length)

    long_enough = texts.where(F.octet_length("body") >= length)
    found = cut_lineage(long_enough.mapInArrow(find, "key binary, vs array<long>"))
    often = found.select(F.explode("vs").alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    wanted = cut_lineage(found.select("key", F.explode(F.array_distinct("vs")).alias("v")).join(often, "v").groupBy("key").agg(F.collect_list("v").alias("wanted")))
    pieces_of = cut_lineage(texts.join(wanted, "key").select("key", "body", "wanted").mapInArrow(cut, "key binary, s long, n long, v long, twice boolean, piece binary"))
    place = F.min(F.struct("key", "s")).alias("place")
    different = cut_lineage(pieces_of.groupBy("piece").agg(F.count("*").alias("copies"), place, F.first("n").alias("n"), F.first("v").alias("v"), F.first("twice").alias("twice")))
    sharing = different.groupBy("v").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + length - 1).alias("bytes"), F.max("twice").alias("twice")).where("kinds > 1 or twice")
    sharing, large = written_count(sharing.select("v", (F.col("bytes") > BLOCK_BYTES).alias("large")), F.col("large"))
    asked = different.join(sharing, "v").select("place.key", F.struct("place.s", "n", "v", "piece", "large").alias("p"))
    # only now the bytes of pieces, one of each kind
    bodies = texts.join(cut_lineage(asked.groupBy("key").agg(F.collect_list("p").alias("ps"))), "key").select("body", "ps").mapInArrow(take, "v long, piece binary, large boolean, body binary")
    by_anchor = bodies.where("not large").select("v", "piece", "body").repartition("v").sortWithinPartitions("v")
    ranges = by_anchor.mapInArrow(index, "piece binary, ranges array<struct<a: long, b: long>>")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    ranges = ranges.union(different.where("copies > 1").select("piece", all_of.alias("ranges")))
    if large:
        ranges = ranges.union(repeated(cut_lineage(bodies.where("large").select(F.col("piece").alias("key"), "body")), length, done + 1))
    placed = pieces_of.select("key", "s", "piece").join(ranges, "piece").select("key", F.transform("ranges", lambda r: F.struct((r["a"] + F.col("s")).alias("a"), (r["b"] + F.col("s")).alias("b"))).alias("ranges"))
    return placed.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "s", "n", "v", "twice", "piece"])


def _indexed(held: list[tuple[bytes, bytes]], length: int) -> pa.RecordBatch:
    found = [union(r) for r in RunLengthIndex([body for _, body in held]).repeats(length)]
    some = [i for i, r in enumerate(found) if r]
    return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some], pa.binary()), _ranges([found[i] for i in some])], names=["piece", "ranges"])


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row with `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` and `removed`, the [a, b) byte ranges that are taken out.

    Work is on different texts, each once: a text of at least `length` bytes that has a copy goes whole. They are written bucketed by
    their key, so the three joins that bring anchors, pieces and ranges back to them don't move texts.

    Null counts as empty; texts shorter than `length` bytes keep all; rows repeated are copies of each other; no rows give none; input
    columns named like a result are replaced.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = [c for c in docs.columns if c.lower() not in (*RESULT, "removed")]
    marked = docs.select(*(F.col(f"`{c}`") for c in kept), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("_llm_sha"))
    key = F.unhex(F.substring("_llm_sha", 1, 32))
    texts, name = bucketed(docs.select(F.sha2(body, 256).alias("_llm_sha"), body.alias("body")).select(key.alias("key"), "body").groupBy("key").agg(F.first("body").alias("body"), F.count("*").alias("copies")), "key")
    ranges = repeated(texts.select("key", "body"), length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, body, own in zip(*b.columns, strict=True):
                out, body, at = hashlib.sha256(), body.as_py(), 0
                gone = union([(r["a"], r["b"] + length - 1) for r in own.as_py()])
                for x, y in gone:
                    out.update(body[at:x])
                    at = y
                out.update(body[at:])
                rows.append((key.as_py(), sum(y - x for x, y in gone), len(gone), out.hexdigest(), gone))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=False)), _ranges(list(columns[4]))], names=["key", "n_removed", "n_spans", "kept", "removed"])

    schema = "key binary, n_removed long, n_spans long, kept string, removed array<struct<a: long, b: long>>"
    single = texts.where("copies = 1").join(ranges, "key").select("key", "body", "ranges").mapInArrow(apply, schema)
    size = F.octet_length("body").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b")))
    copied = texts.where((F.col("copies") > 1) & (size >= length)).select("key", size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept"), whole.alias("removed"))
    changed = cut_lineage(single.union(copied).toDF("_llm_key", "_llm_n", "_llm_spans", "_llm_kept", "_llm_removed"))
    docs.sparkSession.sql(f"drop table {name}")
    joined = marked.join(changed, key == F.col("_llm_key"), "left")
    none = F.lit(0).cast("long")
    return joined.select(
        *(F.col(f"`{c}`") for c in kept), "n_bytes", F.coalesce("_llm_n", none).alias("n_removed"), F.coalesce("_llm_spans", none).alias("n_spans"),
        F.coalesce("_llm_kept", "_llm_sha").alias("kept_sha256"), F.col("_llm_removed").alias("removed"),
    )
