"""Periodic run detection: longest common extensions over a difference cover drive an enumeration of all runs on harmonic grids."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, without

#: A difference cover modulo CYCLE: every residue is a difference of two of its numbers, here in one way only.
CYCLE, COVER = 13, (0, 1, 3, 9)

#: Words of the shortest run.
LEAST = 12

#: Pairs of places looked at together: the memory of one very long text.
PAIRS = 1_000_000

_IN_COVER = np.isin(np.arange(CYCLE), COVER)
#: _SHIFT[i, j]: the least shift that brings places of residues i and j into the cover together.
_SHIFT = np.array([[next(h for h in range(CYCLE) if _IN_COVER[(i + h) % CYCLE] and _IN_COVER[(j + h) % CYCLE]) for j in range(CYCLE)] for i in range(CYCLE)])


class CoverIndex:
    """How far the sequences from two places of one text agree, after a sort of the cover's suffixes only.

    The texts stand one after the other in `words` (numbers of at least 0), text t in [first[t], first[t + 1]). Places whose distance from
    their text's start is in the cover modulo CYCLE are samples. Their suffixes are sorted, text by text, first by CYCLE words, then
    by doubling: the place CYCLE words on is a sample too. A table of minima over what neighbours in the order share answers any two
    samples; any two places reach samples after fewer than CYCLE words.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, [-1]])
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.begin, self.end = first[text], np.append(first[text + 1], n)
        at = np.flatnonzero(_IN_COVER[(np.arange(n) - self.begin) % CYCLE])
        ends = self.end[at]
        block = [np.where(at + i < ends, self.words[np.minimum(at + i, n)], -1) for i in range(CYCLE)]
        order = np.lexsort((*reversed(block), text[at]))
        number = np.full(n + 1, -1)  # of the sample at a place
        number[at] = np.arange(len(at))
        new = text[at][order][1:] != text[at][order][:-1]
        for b in block:
            new |= b[order][1:] != b[order][:-1]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(new))) if len(at) else 0
        levels, width = [rank], CYCLE
        while len(at) and rank.max() < len(at) - 1:
            beyond = at + width < ends
            more = np.where(beyond, rank[number[np.where(beyond, at + width, at)]] + 1, 0)
            pair = rank * (len(at) + 1) + more
            order = np.argsort(pair, kind="stable")
            by = pair[order]
            rank = np.empty(len(at), np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(by[1:] != by[:-1])))
            levels.append(rank)
            width *= 2
        self.number, self.rank = number, rank
        a, b = at[order[:-1]], at[order[1:]]
        shared = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step, x, y = CYCLE << k, a + shared, b + shared
            inside = (x < self.end[a]) & (y < self.end[b])
            same = inside & (levels[k][number[np.where(inside, x, a)]] == levels[k][number[np.where(inside, y, b)]])
            # equal ranks of what reaches the text's end mean equal places, which two places never have
            shared += np.where(same, step, 0)
        shared += self._compare(a + shared, b + shared, CYCLE, np.minimum(self.end[a] - a, self.end[b] - b) - shared)
        shared[self.begin[a] != self.begin[b]] = 0
        self.table = [shared]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            low, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(low[:-half], low[half:]))

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | int, left: np.ndarray) -> np.ndarray:
        """Words that agree from places a and b on, at most `most`, told word by word; `left` are there until a text ends."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        most = np.minimum(most, left)
        for i in range(CYCLE):
            live = live[i < most[live]]
            live = live[self.words[a[live] + i] == self.words[b[live] + i]]
            if not len(live):
                break
            out[live] += 1
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a < b of one text each (the end of all texts included): how many words agree from there on."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b < self.end[np.minimum(a, len(self.words) - 1)])
        a, b = a[live], b[live]
        shift = _SHIFT[(a - self.begin[a]) % CYCLE, (b - self.begin[a]) % CYCLE]
        few = self._compare(a, b, shift, self.end[a] - b)
        out[live] = few
        on = np.flatnonzero((few == shift) & (b + shift < self.end[a]))
        if len(on):
            x, y = self.rank[self.number[a[on] + shift[on]]], self.rank[self.number[b[on] + shift[on]]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp(high - low)[1] - 1  # floor of the logarithm
            least = np.zeros(len(on), np.int64)
            for k in np.unique(level):
                i = np.flatnonzero(level == k)
                least[i] = np.minimum(self.table[k][low[i]], self.table[k][high[i] - (1 << k)])
            out[live[on]] += least
        return out


def grid(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) for all texts, periods up to half of a text, and places at multiples of the period at which a word and the one a period on are equal.

    A run of period p has a multiple of p among its first p places, and that word recurs p on. The grids' places are the lengths times a
    harmonic sum. They come in portions of about PAIRS pairs.
    """
    length = np.diff(first)
    tops = length // 2
    total = int(tops.sum())
    starts = np.concatenate(([0], np.cumsum(tops)))
    for at in range(0, total, PAIRS):
        which = np.arange(at, min(total, at + PAIRS))  # pairs of text and period
        t = np.searchsorted(starts, which, side="right") - 1
        p = which - starts[t] + 1
        points = (length[t] - p - 1) // p + 1
        done = np.concatenate(([0], np.cumsum(points)))
        i = 0
        while i < len(p):
            j = max(i + 1, int(np.searchsorted(done, done[i] + PAIRS, side="right")) - 1)
            n = points[i:j]
            period = np.repeat(p[i:j], n)
            place = np.repeat(first[t[i:j]] - p[i:j] * (done[i:j] - done[i]), n) + period * np.arange(len(period))
            keep = words[place] == words[place + period]
            yield place[keep], period[keep]
            i = j


def near(words: np.ndarray, place: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray, side: int) -> np.ndarray:
    """How many of the CYCLE - 1 words after (side 1) or before (side -1) each place equal the word a period on, up to the first that doesn't; all within [low, high)."""
    out, live = np.zeros(len(place), np.int64), np.arange(len(place))
    for i in range(1, CYCLE):
        x = place[live] + side * i
        y = x + period[live]
        ok = (x >= low[live]) & (y < high[live])
        live, x, y = live[ok], x[ok], y[ok]
        live = live[words[x] == words[y]]
        if not len(live):
            break
        out[live] += 1
    return out


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of the texts in `words` (see CoverIndex) as rows (text, start, length, period), by text, start and period.

    A run is a longest stretch of words that has a smallest period p and at least max(least, 2 * p) words. At each pair of the grid the
    extensions to both sides tell the stretch. Most pairs differ within a few words and are dropped by them; only texts with pairs
    left are indexed, forward and backward. A stretch found with several periods, which are multiples of its smallest, counts with that.
    """
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = np.append(first[text + 1], 0) if len(text) else np.zeros(1, np.int64)
    for place, period in grid(words, first):
        low, high = first[text[place]], stop[place]
        after, before = (near(words, place, period, low, high, side) for side in (1, -1))
        # what the nearest words leave open, or tell to be long enough
        live = (np.maximum(after, before) == CYCLE - 1) | (after + before + 1 >= np.maximum(period, least - period))
        places.append(place[live])
        periods.append(period[live])
    place, period = np.concatenate(places), np.concatenate(periods)
    if not len(place):
        return np.zeros((0, 4), np.int64)
    wanted = np.unique(text[place])
    sizes = np.diff(first)[wanted]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    some = np.concatenate([words[first[t] : first[t + 1]] for t in wanted])
    own = np.searchsorted(wanted, text[place])
    a = place - first[text[place]] + begin[own]
    n = len(some)
    forward = CoverIndex(some, begin).extension(a, a + period)
    # backward: the texts turned round, text by text in turned order
    turned = CoverIndex(some[::-1].copy(), (n - begin)[::-1].copy())
    back = turned.extension(n - (a + period), n - a)
    ok = forward + back >= np.maximum(period, least - period)
    t, start, length, period = wanted[own][ok], (a - back - begin[own])[ok], (forward + back + period)[ok], period[ok]
    order = np.lexsort((period, length, start, t))
    t, start, length, period = (x[order] for x in (t, start, length, period))
    once = np.ones(len(t), bool)
    once[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.stack([t[once], start[once], length[once], period[once]], axis=1)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Every row with `runs` array<struct<start, length, period>> (long; by start, then period), `n_words` long and `collapsed` string.

    Words are numbered from 0. `collapsed` has the words, joined by one blank, that no run holds after its first period. Texts are worked on
    in steps of bounded size, a longer single text is a step of its own; no data is exchanged.

    Null and empty texts have no words, no runs and collapse to an empty text; repeated rows repeat; no rows give none; input columns
    named like a result are replaced.
    """
    rest = without(docs, "runs", "n_words", "collapsed")
    source = rest.select(*(F.col(f"`{c}`") for c in rest.columns), docs[text].cast("binary").alias("_llm_body"))
    kind = "runs array<struct<start: long, length: long, period: long>>, n_words long, collapsed string"
    added = docs.sparkSession.createDataFrame([], kind).schema
    schema, width = rest.schema, len(rest.columns)
    for f in added:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in steps(b.column(width)):
                number: dict[bytes, int] = defaultdict(count().__next__)
                split = [x.split() for x in texts]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                first = np.concatenate(([0], np.cumsum(sizes)))
                words = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(first[-1]))
                found = runs_of(words, first, least)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, first[found[:, 0]] + found[:, 1] + found[:, 3], 1)
                np.add.at(change, first[found[:, 0]] + found[:, 1] + found[:, 2], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = []
                for i, ws in enumerate(split):
                    mask = gone[first[i] : first[i + 1]]
                    kept.append(b" ".join(w for w, g in zip(ws, mask.tolist(), strict=True) if not g) if mask.any() else b" ".join(ws))
                offsets = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, j]) for j in (1, 2, 3)], fields=list(_RUNS)))
                own = [b.column(i).slice(at, len(texts)) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*own, runs, pa.array(sizes), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
