"""Substring dedup: words covered by long windows that also start elsewhere, told by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.session import cut_lineage

from .common import SAME, Words, bucketed, mixed, steps, written_count
from .repeats import hashes, sliding, union

#: Words of the windows that mustn't repeat, and of the anchors in them.
WINDOW, ANCHOR = 35, 8

#: Bytes of different pieces in one reference shard, unless one anchor has more; pieces that share an anchor with more than CROWDED_BYTES are cut
#: anew at longer anchors.
SHARD_BYTES, CROWDED_BYTES = 300_000, 750_000

#: Bytes of all shards' automata up to which they are broadcast; beyond, pieces go to their shard's automaton by a shuffle.
BROADCAST_BYTES = 16_000_000

#: Windows of one piece.
PIECE = 1_024

#: Bytes of texts whose windows are looked at together.
STEP = 400_000

_SEED = 211


class Automaton:
    """The suffix automaton of some word lists, kept where a factor occurs twice or more; its states are numbered from the empty factor, 0."""

    def __init__(self, pieces: list[list[bytes]]):
        nexts: list[dict[bytes, int]] = [{}]
        link, length, times = [-1], [0], [0]
        for words in pieces:
            last = 0
            for c in words:
                q = nexts[last].get(c)
                if q is not None and length[q] == length[last] + 1:
                    last = q
                    times[q] += 1
                    continue
                new = -1
                if q is None:
                    new = len(nexts)
                    nexts.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    times.append(1)
                    p = last
                    while p >= 0 and c not in nexts[p]:
                        nexts[p][c] = new
                        p = link[p]
                    last = new
                    if p < 0:
                        continue
                    q = nexts[p][c]
                    if length[q] == length[p] + 1:
                        link[new] = q
                        continue
                else:
                    p = last
                twin = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                times.append(0)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = twin
                if new >= 0:
                    link[new] = twin
                else:
                    times[twin] = 1
                    last = twin
        for s in sorted(range(1, len(nexts)), key=length.__getitem__, reverse=True):
            times[link[s]] += times[s]
        kept = [0, *(s for s in range(1, len(nexts)) if times[s] > 1)]
        number = dict(zip(kept, range(len(kept)), strict=True))
        self.nexts = [{c: number[q] for c, q in nexts[s].items() if q in number} for s in kept]
        self.link = [number[link[s]] if s else -1 for s in kept]
        self.length = [length[s] for s in kept]

    def repeats(self, words: list[bytes], window: int) -> list[tuple[int, int]]:
        """[first, end) of starts of windows that occur twice, by the matching statistics: the longest match that ends at each word."""
        nexts, link, length = self.nexts, self.link, self.length
        out: list[tuple[int, int]] = []
        state = held = 0
        first = -1
        for i, c in enumerate(words):
            q = nexts[state].get(c)
            while q is None and state:
                state = link[state]
                held = length[state]
                q = nexts[state].get(c)
            if q is not None:
                state, held = q, held + 1
            if held >= window:
                if first < 0:
                    first = i + 1 - window
            elif first >= 0:
                out.append((first, i + 1 - window))
                first = -1
        if first >= 0:
            out.append((first, len(words) + 1 - window))
        return out


class _Windows:
    """All windows of some texts with their anchors: the least hash of the stretches of `k` words in them."""

    def __init__(self, texts: list[bytes], window: int, k: int):
        self.words = w = Words(texts, SAME)
        self.width = window - k + 1
        if len(w) < window:
            self.least = self.hash = np.zeros(0, np.uint64)
            self.inside = np.zeros(0, bool)
        else:
            self.hash = hashes(w.hashes(), k, _SEED)
            self.least = sliding(self.hash, self.width)
            self.inside = w.row[: len(self.least)] == w.row[window - 1 :]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, anchor) by text; twice if the anchor stands at two places of the text or more."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pad = np.zeros(self.width - 1, np.uint64)
        most = sliding(np.concatenate([pad, np.where(self.inside, self.least, np.uint64(0)), pad]), self.width, np.maximum)
        at = np.flatnonzero((self.hash == most) & (most > 0))
        row, value = self.words.row[at], self.hash[at]
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        keep = np.ones(len(row), bool)
        keep[2:] = (row[2:] != row[:-2]) | (value[2:] != value[:-2])
        return row[keep], value[keep]

    def stretches(self, text: np.ndarray, wanted: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, int, int, bool]]:
        """(text, first window, windows, anchor, whether it stands there twice) of runs of windows that have one anchor, if (text, anchor) is among the wanted ones."""
        if not len(self.least):
            return
        row = self.words.row[: len(self.least)]
        cut = np.concatenate(([0], np.flatnonzero((self.least[1:] != self.least[:-1]) | (row[1:] != row[:-1]) | (self.inside[1:] != self.inside[:-1])) + 1))
        mark = lambda r, v: mixed(v ^ mixed(r.astype(np.uint64) + np.uint64(1)))
        value, n, own = self.least[cut], np.diff(np.append(cut, len(row))), row[cut]
        found = np.flatnonzero(self.inside[cut] & np.isin(mark(own, value), mark(text, wanted)))
        for r, s, m, v in zip(own[found].tolist(), cut[found].tolist(), n[found].tolist(), value[found], strict=True):
            for first in range(s, s + m, most):
                some = min(most, s + m - first)
                yield r, first - int(self.words.first_word[r]), some, int(v.view(np.int64)), bool(np.count_nonzero(self.hash[first : first + some + self.width - 1] == v) > 1)

    def body(self, text: int, first: int, words: int) -> bytes:
        at = int(self.words.first_word[text]) + first
        return self.words.data[self.words.start[at] : self.words.end[at + words - 1]].tobytes()


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def repeated(texts: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(key, ranges array<struct<a, b>>): starts of windows that start at two places of the texts (key, body: words parted by blanks), each text once.

    1. Each window has an anchor; equal windows have equal anchors. Anchors met once can't belong to a repeated window: they are counted, and the
       others return to their texts.
    2. Texts are cut into pieces, runs of windows with one such anchor. Pieces are counted by their digest, without their words: all windows of equal
       pieces repeat.
    3. Different pieces with one anchor (and pieces where it stands twice) are the reference. Anchors are dealt to shards of bounded size; a task
       builds a shard's Automaton, of what occurs twice in it.
    4. The automata are broadcast if all of them together are at most BROADCAST_BYTES; then documents are streamed and each piece of theirs is
       matched in its anchor's shard. Beyond, the pieces go to the automata by a shuffle.
    5. Different pieces of an anchor with more than CROWDED_BYTES of them are texts of their own, cut anew at longer anchors: a word by which two
       copies differ stands in most anchors near it, which are then met once and drop out. What is crowded still at anchors of nearly a window is
       settled by counting its windows' digests, so no anchor's pieces ever have to meet in one task.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in steps(b.column(1), STEP):
                row, value = _Windows(some, window, k).anchors()
                offsets = np.searchsorted(row, np.arange(len(some) + 1))
                held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), held], names=["key", "vs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in steps(b.column(1), STEP):
                own = b.column(2).slice(at, len(some))
                text = np.repeat(np.arange(len(some)), np.diff(own.offsets.to_numpy()))
                held, rows = _Windows(some, window, k), []
                for r, s, n, v, twice in held.stretches(text, own.flatten().to_numpy().view(np.uint64)):
                    rows.append((at + r, s, n, v, twice, hashlib.blake2b(held.body(r, s, n + window - 1), digest_size=16).digest()))
                r, *columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["key", "s", "n", "v", "twice", "piece"])

    found = cut_lineage(texts.select("key", "body").mapInArrow(find, "key binary, vs array<long>").where(F.size("vs") > 0))
    each = found.select("key", F.explode("vs").alias("v"))
    often = each.groupBy("v").agg(F.count("*").alias("times")).where("times > 1").select("v")
    wanted = cut_lineage(found.select("key", F.explode(F.array_distinct("vs")).alias("v")).join(often, "v").groupBy("key").agg(F.collect_list("v").alias("vs")))
    pieces = cut_lineage(texts.join(wanted, "key").select("key", "body", "vs").mapInArrow(cut, "key binary, s long, n long, v long, twice boolean, piece binary"))
    place = F.min(F.struct("key", "s")).alias("place")
    different = cut_lineage(pieces.groupBy("piece").agg(F.count("*").alias("copies"), place, F.first("n").alias("n"), F.first("v").alias("v"), F.first("twice").alias("twice")))
    # words are some seven bytes long; what counts is that the sum is bounded
    sharing = different.groupBy("v").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + window - 1).alias("words"), F.max("twice").alias("twice")).where("kinds > 1 or twice")
    sharing, crowded = written_count(sharing.select("v", "words", (F.col("words") * 7 > CROWDED_BYTES).alias("crowded")), F.col("crowded"))
    shards = max(1, -(-int(sharing.where("not crowded").agg(F.sum("words")).head()[0] or 0) * 7 // SHARD_BYTES))
    shard = F.when(~F.col("crowded"), F.pmod(F.xxhash64("v"), F.lit(shards)))
    asked = different.join(sharing.select("v", shard.alias("shard")), "v").select("place.key", F.struct("place.s", "n", "shard", "piece", "copies").alias("p"))
    cuts = texts.join(cut_lineage(asked.groupBy("key").agg(F.collect_list("p").alias("ps"))), "key").select("body", "ps")
    ranges = _matched(cuts, window)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    ranges = ranges.union(different.where("copies > 1").select("piece", all_of.alias("ranges")))
    if crowded:
        longer = window - (window - k) // 4
        ranges = ranges.union(_cut_anew(cuts, window, longer) if longer < window else _counted(cuts, window))
    placed = pieces.select("key", "s", "piece").join(ranges, "piece").select("key", F.transform("ranges", lambda r: F.struct((r["a"] + F.col("s")).alias("a"), (r["b"] + F.col("s")).alias("b"))).alias("ranges"))
    return placed.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _cut_pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[list[tuple[int | None, bytes, int, list[bytes]]]]:
    """Lists of (shard, piece, copies, words) of the places asked for (column ps) in texts (column body); a list has some thousand, or one text's."""
    for b in batches:
        rows: list[tuple] = []
        for body, ps in zip(b.column(0), b.column(1), strict=True):
            words = body.as_py().split()
            rows += [(p["shard"], p["piece"], p["copies"], words[p["s"] : p["s"] + p["n"] + window - 1]) for p in ps.as_py()]
            if len(rows) >= 2_000:
                yield rows
                rows = []
        yield rows


def _matches(rows: list[tuple[bytes, list[tuple[int, int]]]]) -> pa.RecordBatch:
    rows = [r for r in rows if r[1]]
    flat = [x for _, v in rows for x in v]
    offsets = np.concatenate(([0], np.cumsum([len(v) for _, v in rows]))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["piece", "ranges"])


def _matched(cuts: DataFrame, window: int) -> DataFrame:
    """(piece, ranges): starts of windows of each piece met once that occur twice in its shard's automaton."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut_pieces(batches, window):
            rows = [r for r in rows if r[0] is not None]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            bodies = [b" ".join(w) for w in columns[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*columns[:3], bodies), kinds, strict=True)], names=["shard", "piece", "copies", "body"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            for s, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if s != shard and held:
                    yield packed(shard, held)
                    held = []
                shard = s
                held.append(body.split())
        if held:
            yield packed(shard, held)

    def packed(shard: int, held: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pickle.dumps(Automaton(held), 5)], pa.binary())], names=["shard", "automaton"])

    reference = cut_lineage(cuts.mapInArrow(send, "shard long, piece binary, copies long, body binary"))
    by_shard = reference.repartition("shard").sortWithinPartitions("shard")
    automata = cut_lineage(by_shard.mapInArrow(build, "shard long, automaton binary"))
    size = automata.agg(F.sum(F.octet_length("automaton"))).head()[0] or 0
    kind = "piece binary, ranges array<struct<a: long, b: long>>"
    if size <= BROADCAST_BYTES:
        ship = cuts.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["automaton"]) for r in automata.collect()})

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, Automaton] = {}
            for rows in _cut_pieces(batches, window):
                out = []
                for shard, piece, copies, words in rows:
                    if shard is not None and copies == 1:
                        if shard not in known:
                            known[shard] = pickle.loads(ship.value[shard])
                        out.append((piece, known[shard].repeats(words, window)))
                yield _matches(out)

        return cuts.mapInArrow(stream, kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for b in batches:
            out = []
            for piece, body, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if blob is not None:
                    automaton = pickle.loads(blob)
                else:
                    out.append((piece, automaton.repeats(body.split(), window)))
            yield _matches(out)

    none = F.lit(None).cast("binary")
    asking = reference.where("copies = 1").select("shard", "piece", "body", none.alias("automaton"))
    both = asking.union(automata.select("shard", none.alias("piece"), none.alias("body"), "automaton"))
    met = both.repartition("shard").sortWithinPartitions("shard", F.col("automaton").isNull())
    return met.select("piece", "body", "automaton").mapInArrow(meet, kind)


def _cut_anew(cuts: DataFrame, window: int, k: int) -> DataFrame:
    """(piece, ranges): starts of windows of the pieces of crowded anchors that occur twice among them, told at anchors of `k` words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut_pieces(batches, window):
            found = [(piece, b" ".join(words)) for shard, piece, _, words in rows if shard is None]
            keys, bodies = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["key", "body"])

    pieces = cut_lineage(cuts.mapInArrow(each, "key binary, body binary"))
    return repeated(pieces, window, k).select(F.col("key").alias("piece"), "ranges")


def _counted(cuts: DataFrame, window: int) -> DataFrame:
    """(piece, ranges): starts of windows of the pieces of crowded anchors that occur twice among them, each window by its digest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut_pieces(batches, window):
            found = [(piece, i, b" ".join(words[i : i + window])) for shard, piece, _, words in rows if shard is None for i in range(len(words) - window + 1)]
            marks = [hashlib.blake2b(w, digest_size=16).digest() for _, _, w in found]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in found], pa.binary()), pa.array([i for _, i, _ in found], pa.int64()), pa.array(marks, pa.binary())], names=["piece", "i", "mark"])

    windows = cut_lineage(cuts.mapInArrow(each, "piece binary, i long, mark binary"))
    often = windows.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1").select("mark")
    return windows.join(often, "mark").select("piece", F.array(F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b"))).alias("ranges"))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row with `n_words`, `n_removed`, `kept_sha256` and `removed`, the [a, b) ranges of words, numbered from 0, that are taken out.

    Work is on different sequences of words, each once: one of at least `window` words that has a copy goes whole. They are written bucketed by
    their key, so the joins that bring anchors, places and ranges to them don't move texts.

    Null counts as empty; sequences of fewer words keep all; rows repeated are copies of each other; no rows give none; input columns
    named like a result are replaced.
    """
    results = ("n_words", "n_removed", "kept_sha256", "removed")
    kept = [c for c in docs.columns if c.lower() not in results]
    source = docs.select(F.col(text).cast("binary").alias("_llm_body"), *(F.col(f"`{c}`") for c in kept))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("n_words", "long").add("_llm_sha", "binary")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [(len(w), hashlib.sha256(b" ".join(w)).digest()) for w in ((x.as_py() or b"").split() for x in b.column(0))]  # one text's words at a time
            n, shas = zip(*told, strict=True) if told else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(shas, pa.binary())], names=schema.names)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [b" ".join(w) for w in ((x.as_py() or b"").split() for x in b.column(0)) if len(w) >= window]
            keys = [hashlib.sha256(x).digest()[:16] for x in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["key", "body"])

    marked = source.mapInArrow(mark, schema)
    long_enough = source.select("_llm_body").mapInArrow(plain, "key binary, body binary")
    texts, name = bucketed(long_enough.groupBy("key").agg(F.first("body").alias("body"), F.count("*").alias("copies")), "key")
    ranges = repeated(texts.select("key", "body"), window)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, body, own in zip(*b.columns, strict=True):  # ranges as Python objects are large: one row's at a time
                words = body.as_py().split()
                gone = union([(r["a"], r["b"] + window - 1) for r in own.as_py()])
                left, at = [], 0
                for x, y in gone:
                    left += words[at:x]
                    at = y
                rows.append((key.as_py(), sum(y - x for x, y in gone), hashlib.sha256(b" ".join(left + words[at:])).digest(), [{"a": x, "b": y} for x, y in gone]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.binary(), pa.int64(), pa.binary(), _RANGES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["_llm_key", "_llm_n", "_llm_kept", "_llm_removed"])

    result = "_llm_key binary, _llm_n long, _llm_kept binary, _llm_removed array<struct<a: long, b: long>>"
    single = texts.where("copies = 1").join(ranges, "key").select("key", "body", "ranges").mapInArrow(apply, result)
    size = (F.regexp_count(F.col("body").cast("string"), F.lit(" ")) + 1).cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b")))
    copied = texts.where("copies > 1").select("key", size, F.unhex(F.sha2(F.lit("").cast("binary"), 256)), whole)
    changed = cut_lineage(single.union(copied))
    docs.sparkSession.sql(f"drop table {name}")
    joined = marked.join(changed, F.substring("_llm_sha", 1, 16) == F.col("_llm_key"), "left")
    return joined.select(
        *(F.col(f"`{c}`") for c in kept), "n_words", F.coalesce("_llm_n", F.lit(0).cast("long")).alias("n_removed"),
        F.lower(F.hex(F.coalesce("_llm_kept", "_llm_sha"))).alias("kept_sha256"), F.col("_llm_removed").alias("removed"),
    )
