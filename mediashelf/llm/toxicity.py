"""Toxicity: obfuscated words are restored by a noisy channel, then the restored text is scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mixed, steps, sums_between

#: What a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e"}

#: Costs of the channel, in nats: a substitution, a repeated letter left out, a separator left out, a character kept that is no letter.
SUBSTITUTE, REPEAT, SEPARATOR, FOREIGN = 1.0, 0.7, 0.1, 6.0

#: At most about this many labelled rows are used to fit the classifier (chosen by a hash of the key).
FIT_ROWS = 20_000

#: Nats of evidence that a sequence speaks for toxicity before it may be learned.
EVIDENCE = 7.0

#: Letter sequences of GRAM bytes, word boundaries included, fall into BUCKETS.
GRAM, BUCKETS = 5, 1 << 20

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(1, 27)
#: Letters as they are, A-Z as a-z, bytes of other alphabets kept, all else a blank.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[ord(c) for c in "013457@"]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in ".-_*,/~"]] = True
_ISLETTER = _LETTERS > 0
_EDGES = re.compile(r"^[^A-Za-z0-9@$!|+]+|[^A-Za-z0-9@]+$")
#: The same for words that may be obfuscated; and what parts the pieces of a long word.
_OUTER, _PARTS = re.compile(r"^[^A-Za-z0-9@$!|+€]+|[^A-Za-z0-9@$!|+€]+$"), re.compile(r"[^A-Za-z0-9@$!|+€]+")

#: A word of more bytes is read piece by piece; a longer piece or run in windows of WINDOW characters, of which the next shares OVERLAP.
LONG, WINDOW, OVERLAP = 200, 64, 24


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three characters (blank and 26 letters) follow each other in the words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for b in batches:
            for _, texts in steps(b.column(0)):
                c = _LETTERS[np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)].astype(np.int32)
                total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    counted = docs.select(text).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3)
    out[counted["at"].to_numpy(int)] = counted["n"].to_numpy(float)
    return out.reshape(27, 27, 27)


@dataclass
class Channel:
    """The letter model and, over it, the decoder of character lattices."""

    counts: np.ndarray
    known: dict[str, str] = field(default_factory=dict, repr=False)

    @cached_property
    def cost(self) -> list[list[list[float]]]:
        """-log P(c | a, b), mixed with the shorter contexts."""
        c = self.counts
        three = (c + 0.1) / (c + 0.1).sum(axis=2, keepdims=True)
        pairs = c.sum(axis=0) + 0.1
        two = pairs / pairs.sum(axis=1, keepdims=True)
        ones = c.sum(axis=(0, 1)) + 0.1
        return (-np.log(0.7 * three + 0.25 * two[None] + 0.05 * (ones / ones.sum()))).tolist()

    def __getstate__(self):
        return {"counts": self.counts, "known": {}}

    def decode(self, seen: str) -> str:
        """The likeliest word behind what was written: Viterbi over the lattice of what each character may stand for.

        A state is the last two letters. Each character is kept, read as a letter it may stand for, or left out if it is a
        separator or repeats the letter before it; the word must end.
        """
        seen = seen.lower()
        if (found := self.known.get(seen)) is not None:
            return found
        cost, best = self.cost, {(0, 0): (0.0, "")}
        for i, ch in enumerate(seen):
            options = [(ord(ch) - 96, ch, 0.0)] if "a" <= ch <= "z" else [(ord(x) - 96, x, SUBSTITUTE) for x in LEET.get(ch, "")]
            skip = SEPARATOR if ch in " .-_*,/~" else REPEAT if i and seen[i - 1] == ch else None
            if not options and skip is None:
                options = [(0, ch, FOREIGN)]
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (paid, word) in best.items():
                if skip is not None and (word or ch in " .-_*,/~"):
                    if (a, b) not in after or paid + skip < after[a, b][0]:
                        after[a, b] = (paid + skip, word)
                for k, x, extra in options:
                    total = paid + extra + cost[a][b][k]
                    if (b, k) not in after or total < after[b, k][0]:
                        after[b, k] = (total, word + x)
            best = after
        out = min((paid + cost[a][b][0], word) for (a, b), (paid, word) in best.items())[1]
        if len(self.known) < 50_000 and len(seen) < 64:
            self.known[seen] = out
        return out


def suspects(w: Words) -> np.ndarray:
    """(first byte, last byte) of what looks obfuscated, in order, without overlaps.

    These are words in which a character that may stand for a letter comes just before a letter (or a digit of that kind just
    after one), in which a letter comes three times in a row or letters and separators take turns, and runs of four or
    more words of one letter.
    """
    data = w.data
    letter, leet = _ISLETTER[data], _LEET[data]
    odd = np.zeros(len(data), bool)
    odd[:-1] |= leet[:-1] & letter[1:]
    odd[1:] |= _DIGIT[data[1:]] & letter[:-1]
    odd[:-2] |= letter[:-2] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
    turns = letter[:-2] & _SEPARATOR[data[1:-1]] & letter[2:]
    odd[:-4] |= turns[:-2] & turns[2:]
    lengths = w.end - w.start
    has_letter = sums_between(letter, w.start, w.end) >= 2
    single = np.flatnonzero((sums_between(odd, w.start, w.end) > 0) & has_letter & (lengths <= LONG))
    one = (lengths == 1) & letter[w.start]
    change = np.flatnonzero(np.diff(np.concatenate(([False], one, [False])).astype(np.int8)))
    runs = [(a, b) for x, y in zip(change[::2], change[1::2], strict=True) for a, b in _by_row(w.row, x, y) if b - a >= 4]
    spans = [(w.start[i], w.end[i]) for i in single] + [(w.start[a], w.end[b - 1]) for a, b in runs]
    return np.array(sorted(spans), np.int64).reshape(-1, 2)


def doubtful(w: Words, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, last byte) of single words, and of runs, that may be obfuscated though they look like others too.

    Words with a letter and a separator between letters, a doubled letter or a character next to a letter that may stand for one, unless
    they are among the spans `read`, and all longer than LONG with any of these; runs of two or more words of one letter or such a character.
    """
    data = w.data
    letter, leet = _ISLETTER[data], _LEET[data]
    odd = np.zeros(len(data), bool)
    odd[:-1] |= (leet[:-1] & letter[1:]) | (letter[:-1] & leet[1:]) | (letter[:-1] & (data[:-1] == data[1:]))
    odd[:-2] |= letter[:-2] & _SEPARATOR[data[1:-1]] & letter[2:]
    odd[:-2] |= letter[:-2] & _SEPARATOR[data[1:-1]] & leet[2:]
    odd[:-2] |= leet[:-2] & _SEPARATOR[data[1:-1]] & letter[2:]
    euro = (data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC)
    odd[:-2] |= euro
    some = (sums_between(odd, w.start, w.end) > 0) & (sums_between(letter, w.start, w.end) > 0) & ~np.isin(w.start, read[:, 0])
    one = ((w.end - w.start == 1) & (letter | leet)[w.start]) | ((w.end - w.start == 3) & np.append(euro, [False] * 2)[w.start])
    change = np.flatnonzero(np.diff(np.concatenate(([False], one, [False])).astype(np.int8)))
    runs = [(w.start[a], w.end[b - 1]) for x, y in zip(change[::2], change[1::2], strict=True) for a, b in _by_row(w.row, x, y) if b - a >= 2]
    return np.stack([w.start[some], w.end[some]], axis=1), np.array(runs, np.int64).reshape(-1, 2)


def windows(seen: str) -> list[str]:
    """The string, or if it is long, windows of it that overlap."""
    return [seen[a : a + WINDOW] for a in range(0, max(1, len(seen) - OVERLAP), WINDOW - OVERLAP)]


def readings(form: bytes, channel: Channel) -> bytes:
    """The likeliest readings of a word or run, if they are others than what is written; a long word is read piece by piece.

    Pieces of one or two characters in a row are one word with separators; others are words.
    """
    core = _OUTER.sub("", form.decode("utf-8", "replace"))
    if len(form) <= LONG:
        cores = windows(core)
    else:
        cores, short = [], []
        for piece in [*_PARTS.split(core), ""]:
            if 0 < len(piece) <= 2:
                short.append(piece)
                continue
            cores += windows(" ".join(short)) if len(short) > 1 else short
            cores += windows(piece) if piece else []
            short = []
    return b" ".join(x.encode() for c in cores if (x := channel.decode(c)) != c.lower())


def _by_row(row: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    cuts = [x, *(np.flatnonzero(np.diff(row[x:y])) + x + 1), y]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def restored(texts: list[bytes], channel: Channel) -> list[bytes]:
    """The texts with whatever looks obfuscated replaced by its likeliest reading; all else as it was, A-Z as a-z.

    What only may be obfuscated stays, and its readings follow at the end of the text. Each form is read once.
    """
    w = Words(texts)
    spans = suspects(w)
    raw = w.data.tobytes()
    words, runs = doubtful(w, spans)
    more: list[set[bytes]] = [set() for _ in texts]
    known: dict[bytes, bytes] = {}
    for found in (words, runs):
        for i, (a, b) in zip((np.searchsorted(w.row_start, found[:, 0], side="right") - 1).tolist(), found.tolist(), strict=True):
            form = raw[a:b]
            if (x := known.get(form)) is None:
                x = known[form] = readings(form, channel)
            if x:
                more[i].add(x)
    plain = _replaced(w, spans, raw, channel)
    return [b" ".join([t, *sorted(x)]) if x else t for t, x in zip(plain, more, strict=True)]


def _replaced(w: Words, spans: np.ndarray, raw: bytes, channel: Channel) -> list[bytes]:
    texts = range(len(w.row_start) - 1)
    if not len(spans):
        return [raw[a : b - 1] for a, b in zip(w.row_start[:-1], w.row_start[1:], strict=True)]
    out: list[bytes] = []
    which = np.searchsorted(w.row_start, spans[:, 0], side="right") - 1
    k = 0
    for i in range(len(texts)):
        at, end, parts = w.row_start[i], w.row_start[i + 1] - 1, []
        while k < len(spans) and which[k] == i:
            a, b = spans[k]
            core = _EDGES.sub("", raw[a:b].decode("utf-8", "replace"))
            parts += [raw[at:a], channel.decode(core).encode(), b" "]
            at, k = b, k + 1
        out.append(b"".join([*parts, raw[at:end]]))
    return out


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every letter sequence, in text order; sequences of blanks only are left out."""
    plain = _PLAIN[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    keep[np.cumsum(sizes) - sizes] = True  # each text has a blank of its own before it
    row = np.repeat(np.arange(len(texts)), sizes)[keep]
    plain = plain[keep]
    n = max(0, len(plain) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h << np.uint64(8)) | plain[i : i + n]
    within = row[:n] == row[len(row) - n :]
    return row[:n][within], (mixed(h[within]) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Weights of sequences that speak for toxicity, and the log odds of a text that has none."""

    channel: Channel
    weight: np.ndarray
    none: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability that each text is toxic; each sequence counts once a text."""
        row, bucket = grams(restored(texts, self.channel))
        hit = np.flatnonzero(self.weight[bucket])
        pairs = np.unique(np.stack([row[hit], bucket[hit]], axis=1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
        gain = np.bincount(pairs[:, 0], self.weight[pairs[:, 1]], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.none + gain, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", where: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from all documents how letters follow each other, and from labelled ones which sequences speak for toxicity.

    `where` (over the key) says which labelled rows may be used; of these about `fit_rows` are, chosen by a hash of the key. A
    document is toxic if any of its labels is 1. The classifier takes, one after another, the sequence whose share of toxic
    documents is surest to lie above that of all, among the toxic documents not yet explained, so that the chance
    content of toxic documents, and of their copies, is not learned as soon as a telling word explains them.
    """
    spark = docs.sparkSession
    channel = Channel(letter_counts(docs, text))
    use = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    use = (use if where is None else use.where(where)).groupBy(key).agg(F.max(label).cast("int").alias("_llm_label"))
    rows = use.count()
    share = min(1.0, fit_rows / max(rows, 1))
    picked = use.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).withColumnRenamed(key, "_llm_key")
    sample = docs.select(F.col(key).alias("_llm_key"), text).join(F.broadcast(picked), "_llm_key").select("_llm_label", text)
    ship = spark.sparkContext.broadcast(channel)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int32)
        seen = np.zeros(2, np.int64)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for first, texts in steps(b.column(1)):
                row, bucket = grams(restored(texts, ship.value))
                once = np.unique(row * BUCKETS + bucket)
                for c in (0, 1):
                    total[c] += np.bincount((once % BUCKETS)[y[first + once // BUCKETS] == c], minlength=BUCKETS).astype(np.int32)
                    seen[c] += (y[first : first + len(texts)] == c).sum()
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], seen[0])), pa.array(np.append(total[1, at], seen[1]))], names=["at", "clean", "toxic"])

    counted = sample.mapInArrow(count, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counted.where("toxic >= 2 and toxic > clean or at = -1").toPandas().set_index("at")
    clean, toxic = (found.loc[-1, ["clean", "toxic"]] if -1 in found.index else (0, 0))
    found = found.drop(index=-1, errors="ignore")
    weight = np.zeros(BUCKETS, np.float32)
    if not toxic:
        return Model(channel, weight, -30.0)
    base = toxic / (clean + toxic)
    sure = lambda t, c: t * np.log((t + 0.5) / (t + c + 1) / base) + c * np.log(np.maximum((c + 0.5) / (t + c + 1) / max(1 - base, 1e-9), 1e-9))
    found = found[(sure(found["toxic"], found["clean"]) >= EVIDENCE) & (found["toxic"] / (found["toxic"] + found["clean"]) >= 0.8)]
    candidate = np.zeros(BUCKETS, bool)
    candidate[found.index] = True
    ship_candidates = spark.sparkContext.broadcast(np.packbits(candidate))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(ship_candidates.value).astype(bool)
        for b in batches:
            for _, texts in steps(b.column(0)):
                row, bucket = grams(restored(texts, ship.value))
                at = wanted[bucket]
                once = np.unique(row[at] * BUCKETS + bucket[at])
                for r in np.unique(once // BUCKETS):
                    yield pa.RecordBatch.from_arrays([pa.array([(once[once // BUCKETS == r] % BUCKETS).tolist()], pa.list_(pa.int32()))], names=["has"])

    held = [set(map(int, x)) for x in sample.where("_llm_label = 1").select(text).mapInArrow(hits, "has array<int>").toPandas()["has"]]
    where_found: dict[int, set[int]] = {}
    for i, has in enumerate(held):
        for g in has:
            where_found.setdefault(g, set()).add(i)
    left, cleans, explained = {g: len(s) for g, s in where_found.items()}, found["clean"].to_dict(), set()
    while left:
        g = max(left, key=lambda g: (left[g] - 3 * cleans.get(g, 0), -g))
        t, c = left[g], int(cleans.get(g, 0))
        if t < 2 or sure(t, c) < EVIDENCE:
            break
        weight[g] = math.log((t + 0.5) / (c + 0.5)) + math.log((clean + 1) / (toxic + 1)) + 2
        new = where_found[g] - explained
        explained |= new
        for i in new:
            for other in held[i]:
                left[other] = left.get(other, 1) - 1
        left = {k: n for k, n in left.items() if n >= 2}
    none = math.log((len(held) and max(toxic - len(explained), 0) + 0.5) or toxic + 0.5) - math.log(clean + 1)
    return Model(channel, weight, float(np.clip(none, -4.0, -2.0)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with `score` (0 to 1) and `predicted` (1 if score >= 0.5); columns of these names are replaced.

    Null and empty texts have nothing against them and get the score of a text without any telling sequence.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    source = docs.select(F.col(text).alias("_llm_body"), *(F.col(f"`{c}`") for c in kept))
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([ship.value.scores(texts) for _, texts in steps(b.column(0))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = source.drop("_llm_body").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return source.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """`fit` and `score` in one: all rows of `docs` with score and predicted.

    Rows repeated in `docs` are scored alike; labels that repeat count once, null labels and keys don't count; without any toxic
    label every score is near 0; no documents give no rows.
    """
    return score(docs, fit(docs, labels, key=key, text=text, where=where), text)


__all__ = ["Channel", "Model", "fit", "grams", "letter_counts", "restored", "score", "scored"]
