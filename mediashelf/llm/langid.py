"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed-language text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Words, mixed, steps, sums_between

#: At most about this many rows with a language are used to fit the model (chosen by a hash of the text).
FIT_ROWS = 20_000

#: Sequences of three bytes, word boundaries included, fall into BUCKETS.
BUCKETS = 1 << 15

#: What a change of language costs, in nats, and a word in a script the language isn't written in.
SWITCH, WRONG_SCRIPT = 12.0, 50.0

#: A language is written in a script if at least this share of its letters is.
SCRIPT_SHARE = 0.01

#: Scripts as ranges of code points (letters only; signs between them count as part of the range).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58A),),
    "hebrew": ((0x5D0, 0x5F2),),
    "arabic": ((0x620, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)),
}
_RANGES = sorted((a, b, 1 << i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_LOW, _HIGH, _BIT = (np.array(x) for x in zip(*_RANGES, strict=True))


def scripts(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 text that begins a letter, the bit of its script; 0 elsewhere."""
    out = np.zeros(len(data), np.uint16)
    out[((data | 32) >= 97) & ((data | 32) <= 122)] = 1
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = [np.where(lead + k < len(data), data[np.minimum(lead + k, len(data) - 1)], 0).astype(np.int64) & 0x3F for k in (1, 2, 3)]
        b = data[lead].astype(np.int64)
        two, three = ((b & 0x1F) << 6) | more[0], ((b & 0x0F) << 12) | (more[0] << 6) | more[1]
        cp = np.where(b < 0xE0, two, np.where(b < 0xF0, three, ((b & 7) << 18) | (more[0] << 12) | (more[1] << 6) | more[2]))
        at = np.maximum(np.searchsorted(_LOW, cp, side="right") - 1, 0)
        out[lead] = np.where((cp >= _LOW[at]) & (cp <= _HIGH[at]), _BIT[at], 0)
    return out


def trigrams(w: Words) -> np.ndarray:
    """The bucket of the three bytes around each byte; what is no letter counts as a boundary."""
    d = w.data
    plain = np.where((d >= 128) | ((d >= 97) & (d <= 122)), d, 32).astype(np.uint64)
    around = np.concatenate(([32], plain, [32])).astype(np.uint64)
    h = (around[:-2] << np.uint64(16)) | (around[1:-1] << np.uint64(8)) | around[2:]
    return (mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    """Languages with their log probabilities of trigrams (bucket, language) and the scripts they are written in."""

    languages: list[str]
    logp: np.ndarray
    written: np.ndarray

    def words(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each word in each language, letters of each word)."""
        kinds = scripts(w.data)
        letters = sums_between(kinds > 0, w.start, w.end)
        gram, part = trigrams(w), np.zeros((len(w), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            part[:, k] = sums_between(self.logp[gram, k], w.start, w.end)
        part -= part.max(axis=1, keepdims=True, initial=-np.inf) if len(w) else 0
        bits = np.bitwise_or.reduceat(np.append(kinds, 0), np.stack([w.start, w.end], axis=1).ravel())[::2] if len(w) else np.zeros(0, np.uint16)
        fits = (bits[:, None] & self.written[None, :]) > 0
        part -= WRONG_SCRIPT * (~fits & fits.any(axis=1, keepdims=True))
        part[letters == 0] = 0
        return part, letters


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word: the path of the highest sum of scores less `switch` for each change, text by text.

    first[i]:first[i + 1] are the words of text i. If no stretch of a text gains more than switch / 2 in another language
    than the one best overall, no change can pay, and the path is that language throughout; such texts, nearly all, are told
    by sums and running minima. The others go word by word, all texts of the batch in step.
    """
    n, width = score.shape
    lengths = np.diff(first)
    texts = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros(n, np.int32)
    if not n or width < 2:
        return out
    total = sums_between(score, first[:-1], first[1:])
    best = total.argmax(axis=1)
    out[:] = best[texts]
    own = score[np.arange(n), out].astype(np.float64)
    apart = np.abs(score).sum() * 4 + 1
    mixed_texts = np.zeros(len(lengths), bool)
    for k in range(width):
        gain = np.cumsum(score[:, k] - own) - texts * apart
        before = np.minimum.accumulate(gain - (score[:, k] - own) - 0.0)
        mixed_texts[np.unique(texts[gain - before > switch / 2])] = True
    which = np.flatnonzero(mixed_texts)
    which = which[np.argsort(-lengths[which], kind="stable")]
    if not len(which):
        return out
    start, length = first[:-1][which], lengths[which]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts with a word at each step
    value = score[start].astype(np.float64)
    stays, tops = np.zeros((n, width), bool), np.zeros(n, np.int32)
    for t in range(1, length[0]):
        m = live[t]
        v, at = value[:m], start[:m] + t
        top = v.argmax(axis=1)
        reach = v[np.arange(m), top][:, None] - switch
        stay = v >= reach
        stays[at], tops[at] = stay, top
        value[:m] = np.where(stay, v, reach) + score[at]
    label = value.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = np.where(stays[at, label[:m]], label[:m], tops[at])
    return out


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", where: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Learn trigrams and scripts of each language from rows that have one (`where`: which of them may be used).

    Of these about `fit_rows` are used, whole texts, chosen by a hash of the text. Only counts per language and bucket come to the driver.
    """
    use = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    use = use if where is None else use.where(where)
    share = min(1.0, fit_rows / max(use.count(), 1))
    sample = use.where(F.pmod(F.xxhash64(F.col(text), F.lit(5)), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select(F.col(lang).cast("string"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(0).to_pylist()
            for first, texts in steps(b.column(1)):
                for name in set(names[first : first + len(texts)]):
                    w = Words([x for x, own in zip(texts, names[first:], strict=False) if own == name])
                    mine = counts.setdefault(name, np.zeros(BUCKETS + 16, np.int64))
                    inside = np.zeros(len(w.data), bool)
                    inside[_spread(w.start, w.end)] = True
                    mine[:BUCKETS] += np.bincount(trigrams(w)[inside], minlength=BUCKETS)
                    kinds = scripts(w.data)
                    mine[BUCKETS:] += [(kinds == 1 << i).sum() for i in range(16)]
        for name, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], names=["lang", "at", "n"])

    found = sample.mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + 16, len(languages)))
    counts[found["at"].to_numpy(int), found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = found["n"]
    smooth = counts[:BUCKETS] + 0.5
    shares = counts[BUCKETS:] / np.maximum(counts[BUCKETS:].sum(axis=0), 1)
    bits = ((shares >= SCRIPT_SHARE) * (1 << np.arange(16))[:, None]).sum(axis=0).astype(np.uint16)
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), bits)


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of the spans."""
    n = end - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def spans(texts: list[bytes], model: Model) -> list[list[tuple[int, int, str]]]:
    """For each text the spans (first byte, end byte, language) of words in one language."""
    w = Words(texts)
    score, _ = model.words(w)
    label = viterbi(score, w.first_word)
    out: list[list[tuple[int, int, str]]] = []
    for i in range(len(texts)):
        a, b = w.first_word[i], w.first_word[i + 1]
        cuts = [a, *(np.flatnonzero(np.diff(label[a:b])) + a + 1), b] if b > a else []
        out.append([(int(w.start[x] - w.row_start[i]), int(w.end[y - 1] - w.row_start[i]), model.languages[label[x]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
    return out


def predict(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray]:
    """The language that holds most letters of each text and the share it holds; `und`, 0 for texts without letters."""
    n = len(model.languages)
    w = Words(texts)
    score, letters = model.words(w)
    label = viterbi(score, w.first_word)
    held = np.bincount(w.row * n + label, letters, minlength=len(texts) * n).reshape(len(texts), n)
    best, all_letters = held.argmax(axis=1), held.sum(axis=1)
    for i in np.flatnonzero(all_letters == 0):  # letters of other scripts, if any
        if any(map(str.isalpha, texts[i].decode())):
            a, b = w.first_word[i], w.first_word[i + 1]
            best[i], held[i], all_letters[i] = score[a:b].sum(axis=0).argmax(), 1 / n, 1
    return [model.languages[k] if s else "und" for k, s in zip(best, all_letters, strict=True)], held[np.arange(len(texts)), best] / np.maximum(all_letters, 1)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with `lang_pred`, `score` and `spans` (first byte, end byte, language); columns of these names are replaced.

    Null, empty and letterless texts are `und` with score 0 (their words, if any, still lie in spans); so is every text if the model
    knows no language. Texts are taken whole.
    """
    return _labelled(docs, model, text, with_spans=True)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`identify` without the spans."""
    return _labelled(docs, model, text, with_spans=False)


def _labelled(docs: DataFrame, model: Model, text: str, with_spans: bool) -> DataFrame:
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "spans")]
    source = docs.select(F.col(text).alias("_llm_body"), *(F.col(f"`{c}`") for c in kept))
    ship = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    step = max(50_000, STEP_BYTES * 8 // max(8, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ship.value
        for b in batches:
            names, shares, found = [], [np.zeros(0)], []
            for _, texts in steps(b.column(0), step):
                name, share = predict(texts, m) if m.languages else (["und"] * len(texts), np.zeros(len(texts)))
                names += name
                shares.append(share)
                if with_spans:
                    found += [[dict(zip(("first", "end", "lang"), s, strict=True)) for s in x] for x in spans(texts, m)] if m.languages else [[]] * len(texts)
            more = [pa.array(found, span)] if with_spans else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(np.concatenate(shares)), *more], names=[*kept, "lang_pred", "score", *["spans"] * with_spans])

    schema = source.drop("_llm_body").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
    if with_spans:
        schema = schema.withColumn("spans", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("end"), F.lit("").alias("lang"))))
    return source.mapInArrow(run, schema.schema)
