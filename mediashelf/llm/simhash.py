"""SimHash near-duplicates by multi-index hashing: fingerprints of word shingles linked at two or fewer differing bits, and wide ones whose neighbours are compared set by set."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import erfc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from mediashelf.session import cut_lineage

from .common import Words, bucketed, components, mixed, steps, written_count

#: Shingles hashed together: the memory of one very long text.
BLOCK = 50_000

#: A wide fingerprint: CHECK bits that go with every key, then segments of SEGMENT bits. At a similarity of 0.8 (cosine 0.89) 15 % of the bits differ.
BITS, CHECK, SEGMENT = 1024, 64, 24
SEGMENTS = (BITS - CHECK) // SEGMENT

#: Keys of a fingerprint, and how many bits of a segment, the least sure ones, its ball may flip: of all values in the balls of all segments the
#: likeliest are the keys.
KEYS, UNSURE = 128, 6

#: In how many bits fingerprints of sets to be compared may differ (at 0.8 more do once in 100,000), and those of sets of fewer than FEW shingles,
#: whose bits often stand at exactly half; in how many of the CHECK bits; and from how many documents on a key keeps all without that check.
MOST, MOST_OF_FEW, FEW, NEAR, CROWD = 204, 240, 6, 22, 32

#: Documents of one crowd, and bytes of their texts, that are compared at once; more are dealt to pairs of blocks. Documents of one key compared at once.
BLOCK_DOCS, BLOCK_BYTES, KEY_DOCS = 2048, 4_000_000, 512

#: Keys of documents whose texts are fetched by a broadcast; more are fetched by a shuffle of the texts.
BROADCAST_KEYS = 500_000


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64 bits as a signed number: a bit is 1 if it is set in over half the hashes of the text's word shingles, repeats included.

    A-Z count as a-z. Fewer words than a shingle has give one shingle of all of them; no words give 0.
    """
    w = (text or b"").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in islice(grams, BLOCK)), np.uint64, min(BLOCK, n - at))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(ones * 2 > n).tobytes(), ">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", *, words: int = 3, seed: int = 42, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(the columns in `keep`, default all, _llm_fp long); the text is read once, batch by batch."""
    kept = [c for c in docs.columns if keep is None or c in keep]
    source = docs.select(F.col(text).cast("binary").alias("_llm_body"), *(F.col(f"`{c}`") for c in kept))
    schema = source.drop("_llm_body").withColumn("_llm_fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array((fingerprint(x.as_py(), words, seed) for x in b.column(0)), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], prints], names=[*kept, "_llm_fp"])

    return source.mapInArrow(run, schema)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints (column _llm_fp, each once) that connect all pairs at two or fewer bits.

    The 64 bits are two segments of 32. For each segment the ball of radius 1 around its value is enumerated, the other
    segment as it is: 65 keys with the fingerprint itself. Two fingerprints at distance 2 meet at two keys (flip one of the two bits in one, the other
    in the other), at distance 1 at their own values; and two that meet are at most 2 apart. A key's matches are thus all near each other, so linking
    each to the next in order is enough: rows stay in proportion to the fingerprints, and no key can have more than 65 matches.
    The complete distance is verified all the same.
    """
    segments = [[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(low, low + 32)] for low in (0, 32)]
    ball = F.array(F.col("_llm_fp"), *(F.col("_llm_fp").bitwiseXOR(flip) for flips in segments for flip in flips))
    near = prints.select("_llm_fp", F.explode(ball).alias("key"))
    fetched = near.select("_llm_fp", F.lag("_llm_fp").over(Window.partitionBy("key").orderBy("_llm_fp")).alias("before"))
    return fetched.where(F.col("before").isNotNull()).where(distance("_llm_fp", "before") <= 2).select(F.col("before").alias("a"), F.col("_llm_fp").alias("b")).distinct()


def distance(a: str, b: str) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component_id): every document with its fingerprint and the smallest key it can reach over links.

    Copies share a fingerprint and are one node, so a group of a million copies costs one node and its rows. Components are
    found among linked fingerprints only; all state is in the shared folder. Fingerprints without a link skip it.

    Null, empty and blank texts have fingerprint zero and are linked like others; null keys never name a component (its id is
    null only if all its keys are); repeated rows give repeated rows; no documents give no rows; other columns play no part.
    """
    marked = cut_lineage(with_fingerprint(docs, text, words=words, seed=seed, keep=(key,)))
    nodes = cut_lineage(marked.groupBy("_llm_fp").agg(F.min(key).alias("_llm_least")))
    roots = components(cut_lineage(links(nodes)))
    rooted = cut_lineage(nodes.join(roots, nodes["_llm_fp"] == roots["node"]).select("_llm_fp", "root", "_llm_least"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("_llm_least").alias("_llm_id")), "root").select("_llm_fp", "_llm_id")
    known = nodes.join(named, "_llm_fp", "left").select("_llm_fp", F.when(F.col("_llm_id").isNull(), F.col("_llm_least")).otherwise(F.col("_llm_id")).alias("component_id"))
    joined = marked.join(known, "_llm_fp")
    return joined.select(key, F.lpad(F.lower(F.hex("_llm_fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The set of each text's word shingles, as sorted 64-bit hashes; fewer words make one shingle, no words an empty one.

    A-Z count as a-z. Blanks part words, so sets don't depend on which.
    """
    w = Words(texts)
    h, lengths = w.hashes(), np.diff(w.first_word)
    n = np.maximum(1, lengths - words + 1)
    row, ends = np.repeat(np.arange(len(texts)), n), np.cumsum(n)
    held = np.minimum(lengths, words)[row]
    start = w.first_word[:-1][row] + np.arange(len(row)) - (ends - n)[row]
    out = mixed(held.astype(np.uint64) + np.uint64(1))
    for i in range(words):
        at = np.flatnonzero(held > i)
        out[at] = mixed(out[at] * np.uint64(0x9E3779B97F4A7C15) + h[start[at] + i])
    return [np.unique(out[b - k : b]) for b, k in zip(ends, n, strict=True)]


_LANES = np.random.default_rng(11).integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Chance that a bit differs in a set 0.8 similar, by its count's distance from half in 1/32 of standard deviations; as logarithms.
_FLIP = np.array([erfc(1.94 * (i + 0.5) / 32 / 2**0.5) / 2 for i in range(129)])
_STAYS, _ODDS = np.log1p(-_FLIP), np.log(_FLIP) - np.log1p(-_FLIP)
_SUBSETS = np.arange(1 << UNSURE)[:, None] >> np.arange(UNSURE) & 1


def tally(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes, each spread to BITS bits, every bit is set; counters of a byte, 255 hashes at once."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):
        spread = mixed(hashes[at : at + 255, None] * _LANES)
        ones += np.unpackbits(spread.view(np.uint8), axis=1).view(np.uint64).sum(axis=0).view(np.uint8)
    return ones


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the wide fingerprint of each set and, as last word, in how many bits others may differ; its KEYS keys).

    A bit is 1 if it is set in over half the hashes. A key is a segment's number and a value of the ball around the segment: up to UNSURE bits,
    those whose counts are nearest to half, flipped. Bits that differ between similar sets are mostly such.
    """
    n = np.array([len(s) for s in sets])
    over = 2 * np.stack([tally(s) for s in sets]) - n[:, None]
    bits = over > 0
    step = np.minimum(np.abs(over[:, CHECK:]) / np.sqrt(n)[:, None] * 32, 128).astype(np.int64).reshape(-1, SEGMENTS, SEGMENT)
    odds = _ODDS[step]
    unsure = np.argpartition(-odds, UNSURE, axis=2)[:, :, :UNSURE]
    value = (bits[:, CHECK:].reshape(step.shape) @ (1 << np.arange(SEGMENT))) + (np.arange(SEGMENTS) << SEGMENT)
    ball = (value[:, :, None] ^ ((1 << unsure) @ _SUBSETS.T)).reshape(len(sets), -1)
    chance = (_STAYS[step].sum(axis=2)[:, :, None] + np.take_along_axis(odds, unsure, 2) @ _SUBSETS.T).reshape(len(sets), -1)
    likeliest = np.argpartition(-chance, KEYS, axis=1)[:, :KEYS]
    words = np.packbits(bits, axis=1).view(np.uint64)
    return np.column_stack([words, np.where(n < FEW, MOST_OF_FEW, MOST).astype(np.uint64)]), np.take_along_axis(ball, likeliest, 1).astype(np.int32)


def differing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many bits signatures differ, row by row, and whether so few that their sets are to be compared."""
    n = np.bitwise_count(x[..., :-1] ^ y[..., :-1]).sum(axis=-1, dtype=np.int32)
    return n, n <= np.maximum(x[..., -1], y[..., -1])


def with_signature(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, _llm_set binary: the set's digest, sig binary: its signature, keys array<int>, size: bytes of the text); the text is read once."""
    source = docs.select(F.col(text).cast("binary").alias("_llm_body"), key)
    schema = source.select(key, F.lit(b"").alias("_llm_set"), F.lit(b"").alias("sig"), F.array(F.lit(0)).alias("keys"), F.lit(0).cast("long").alias("size")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in steps(b.column(0)):
                sets = shingle_sets(texts, words)
                for at in range(0, len(sets), 256):
                    some, sizes = sets[at : at + 256], list(map(len, texts[at : at + 256]))
                    sig, keys = signatures(some)
                    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in some]
                    columns = [pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(list(keys), pa.list_(pa.int32())), pa.array(sizes, pa.int64())]
                    yield pa.RecordBatch.from_arrays([b.column(1).slice(first + at, len(some)), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _heads(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """For each row the first of its key that a chain of rows near each other (by their check bits) leads to; -1 for rows near no other."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(start, append=len(key))
    crowded = np.repeat(size > CROWD, size)
    head, met = np.where(crowded, np.repeat(start, size), np.arange(len(key))), crowded.copy()
    left, right = [], []
    for d in range(1, min(size.max(), CROWD)):
        i = np.flatnonzero((key[d:] == key[:-d]) & ~crowded[d:])
        i = i[np.bitwise_count(check[i] ^ check[i + d]) <= NEAR]
        left.append(i)
        right.append(i + d)
    if left:
        x, y = np.concatenate(left), np.concatenate(right)
        met[x] = met[y] = True
        while (head[x] != head[y]).any():
            low = np.minimum(head[x], head[y])
            np.minimum.at(head, x, low)
            np.minimum.at(head, y, low)
    return np.where(met, head, -1)


def meetings(keys: DataFrame) -> DataFrame:
    """(key, head, node): those of the rows (key, node, check) near another of their key, with the least node of those a chain of near ones leads to.

    A key with more than CROWD rows keeps all, with its least node as head. Rows are read in order; of a crowded key only its head is held.
    """
    kind = keys.select("key", F.col("node").alias("head"), "node").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot, top = None, None, None  # rows of the last key, which may go on; a crowded key that may go on, and its head
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
            key = t.column(0).to_numpy()
            lead = int(np.searchsorted(key, hot, "right")) if hot is not None else 0
            if lead:
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in (t.column(0)[:lead], pa.chunked_array([pa.repeat(top, lead)]), t.column(1)[:lead])], names=kind.names)
            t, key, rest = t.slice(lead), key[lead:], None
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            crowded = len(key) - last > CROWD
            hot, top = (key[-1], t.column(1)[last]) if crowded else (None, None)
            if not crowded:
                rest = t.slice(last).combine_chunks().to_batches()[0]
                t, key = t.slice(0, last), key[:last]
            if len(key):
                yield found(t, key)
        if rest is not None:
            t = pa.Table.from_batches([rest])
            yield found(t, t.column(0).to_numpy())

    def found(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        head = _heads(key, t.column(2).to_numpy().view(np.uint64))
        at = np.flatnonzero(head >= 0)
        columns = [t.column(c).combine_chunks().take(pa.array(i)) for c, i in ((0, at), (1, head[at]), (1, at))]
        return pa.RecordBatch.from_arrays(columns, names=kind.names)

    return keys.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "check").mapInArrow(run, kind)


def _nearest(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each signature the first that a chain of near ones leads to, the nearest other one, in how many bits it differs, and how many are near."""
    bits, near = differing(sig[:, None], sig[None])
    np.fill_diagonal(near, False)
    head, low = None, np.arange(len(sig))
    while head is None or (low != head).any():
        head, low = low, np.minimum(low, np.where(near, low, len(sig)).min(axis=1))
    bits = np.where(near, bits, BITS + 1)
    return head, bits.argmin(axis=1), bits.min(axis=1), near.sum(axis=1)


def neighbours(rows: DataFrame, most: int = KEY_DOCS) -> DataFrame:
    """(node, crowd, near, bits, many): for rows (key, node, sig) near another of their key the least node that a chain of near ones leads to, the nearest one,
    in how many bits it differs, and how many are near.

    A key with over `most` rows is one crowd under its least node, and its rows are compared by so many, each time with that node; bits are more than
    BITS for those near none of them.
    """
    kind = rows.select("node", F.col("node").alias("crowd"), F.col("node").alias("near"), F.lit(0).alias("bits"), F.lit(0).cast("long").alias("many")).schema
    names = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, held, large = [], None, [], False
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    out += found(held, large)
                    key, held, large = k, [], False
                elif len(held) == most:
                    out += found(held, True)
                    held, large = held[:1], True
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=names)
            out = []
        yield pa.RecordBatch.from_pylist(found(held, large), schema=names)

    def found(held: list, large: bool) -> list[dict]:
        if len(held) < 2:
            return []
        node = [n for n, _ in held]
        rows = zip(node, *(x.tolist() for x in _nearest(_words([s for _, s in held]))), strict=True)
        return [
            {"node": n, "crowd": node[0 if large else head], "near": node[near], "bits": bits, "many": many}
            for n, head, near, bits, many in rows
            if many or large
        ]

    return rows.select("key", "node", "sig").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, kind)


def close(pairs: DataFrame) -> DataFrame:
    """(a, b, bits) of pairs (a, b, x, y), x and y their signatures: in how many bits they differ, where their sets are to be compared."""
    kind = pairs.select("a", "b", F.lit(0).alias("bits")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, few = differing(*(_words(c.to_pylist()) for c in b.columns[2:]))
            ok = pa.array(few)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(n).filter(ok)], names=["a", "b", "bits"])

    return pairs.mapInArrow(run, kind)


def _words(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, BITS // 64 + 1)


def alike(pairs: DataFrame, bodies: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets have at least 4 of 5 of their shingles together in common."""
    kind = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = steps(pa.concat_arrays([b.column(2), b.column(3)]).take(pa.array(np.arange(2 * len(b)).reshape(2, -1).T.ravel())))  # text by text of each pair
            sets, done = [], 0
            for _, texts in x:
                sets += shingle_sets(texts, words)
                ok = []
                for i in range(0, len(sets) - 1, 2):
                    shared = len(np.intersect1d(sets[i], sets[i + 1], assume_unique=True))
                    ok.append(5 * shared >= 4 * (len(sets[i]) + len(sets[i + 1]) - shared))
                yield pa.RecordBatch.from_arrays([c.slice(done, len(ok)).filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])
                sets, done = sets[2 * len(ok) :], done + len(ok)

    left, right = (bodies.select(F.col("node").alias(c), F.col("body").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    return cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each (key, i, j), which stand together, column by column."""
    now, held = None, None
    for b in batches:
        columns = b.to_pydict()
        for at, k in enumerate(zip(columns["key"], columns["i"], columns["j"], strict=True)):
            if k != now:
                if held:
                    yield held
                now, held = k, {c: [] for c in columns}
            for c, v in columns.items():
                held[c].append(v[at])
    if held:
        yield held


def _promising(block: dict[str, list]) -> np.ndarray:
    """Which documents of a pair of blocks, or of one, differ in few enough bits from one of another group; a matrix."""
    sig, own, alone = _words(block["sig"]), np.array(block["own"]), block["i"][0] == block["j"][0]
    part = np.unique(np.array(block["part"], object), return_inverse=True)[1]
    out = np.zeros((len(sig), len(sig)), bool)
    for i in np.flatnonzero(part != np.bincount(part).argmax()):
        j = np.flatnonzero((part != part[i]) & (alone | (own != own[i])))
        out[i, j] = out[j, i] = differing(sig[j], sig[i])[1]
    return out


def _linked(block: dict[str, list], words: int) -> Iterator[tuple[int, int]]:
    """Pairs of documents of a block, at least 0.8 similar by their sets, that hang all its groups together that can be so."""
    near = _promising(block)
    sets = [s for _, texts in steps(pa.array(block["body"], pa.binary())) for s in shingle_sets(texts, words)]
    size = np.array(list(map(len, sets)))
    number, at = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    root = np.unique(np.array(block["part"], object), return_inverse=True)[1]
    flag = np.zeros(len(number), np.int64)
    for i in np.argsort(-near.sum(axis=1), kind="stable"):
        if not (near[i] & (root != root[i])).any():
            continue
        own = at[first[i] : first[i] + size[i]]
        flag[own] = 1
        shared = np.add.reduceat(flag[at], first)
        flag[own] = 0
        for j in np.flatnonzero(near[i] & (5 * shared >= 4 * (size + size[i] - shared))):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield int(i), int(j)


def deal(rooted: DataFrame) -> DataFrame:
    """(key: the crowd, i, j, own, node, part, sig): documents (node, crowd, part, sig, size) of crowds with several groups, once for each pair of blocks (i, j), or
    one block, that compares theirs, `own`, with others.

    The largest group of a crowd has its own blocks, which meet those of the rest but not each other. A crowd that fits in a block is one, and in crowds
    of two the only pair is decided.
    """
    largest, n, size = F.max(F.struct("n", "part", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")
    parts = rooted.groupBy("crowd", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = parts.groupBy("crowd").agg(largest, n, size).where("n > 2 and n > main.n")

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK_DOCS, size / BLOCK_BYTES, F.lit(1))).cast("int")

    one = blocks(F.col("n"), F.col("size")) == 1
    mains = F.when(one, 0).otherwise(blocks(F.col("main.n"), F.col("main.size"))).alias("mains")
    others = F.when(one, 1).otherwise(blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))).alias("others")
    left = rooted.join(parts.select("crowd", F.col("main.part").alias("main"), mains, others), "crowd")
    at, apart = F.xxhash64("node"), (F.col("part") == F.col("main")) & (F.col("mains") > 0)
    own = F.when(apart, F.col("others") + F.pmod(at, "mains")).otherwise(F.pmod(at, "others")).cast("int").alias("own")
    met = F.explode(F.sequence(F.lit(0), F.when(apart, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)).alias("met")
    dealt = left.select("crowd", "node", "part", "sig", own, met)
    return dealt.select(F.col("crowd").alias("key"), F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "node", "part", "sig")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5) -> DataFrame:
    """(key, component_id): groups of documents linked by pairs whose sets of word shingles have a Jaccard similarity of 0.8 or more.

    Only such pairs link: each is compared set by set. They are sought by wide SimHash fingerprints in a multi-index of SEGMENTS tables: a document
    has KEYS keys however long it is, values of the balls around its segments. At a similarity of 0.8 about one pair in 500 isn't found, at higher
    ones fewer.

    1. Documents that meet at a key and whose fingerprints differ little form a crowd, together with what they so meet at other keys.
    2. In it each is compared with the one from whose fingerprint its own differs least, and with the one that is near to most.
    3. Where several groups are left in a crowd, those outside its largest group are compared with all, in blocks of bounded size, pairs of blocks where
       there are many. However many keys two documents share, they stand in their crowd once, and those of the largest group aren't compared with each
       other. Documents whose fingerprints differ little from one of another group get their texts, and groups are hung together set by set; a group
       once hung to another isn't compared with it again. Only links leave a block, no list of pairs.

    Equal sets are one node, so copies cost one. Keys must tell documents apart; those without one (null) aren't grouped. Null, empty and blank
    texts are alike; rows repeated are one document and come back as often; no documents, no rows; other columns play no part.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_llm_key"), F.col(text).alias("_llm_text"))
    marked = cut_lineage(with_signature(known, "_llm_key", "_llm_text", words))
    nodes = cut_lineage(marked.groupBy("_llm_set").agg(F.min("_llm_key").alias("node"), *(F.first(c).alias(c) for c in ("sig", "keys", "size"))))
    check = F.conv(F.hex(F.substring("sig", 1, CHECK // 8)), 16, -10).cast("long")
    keys = nodes.select("node", check.alias("check"), F.explode("keys").alias("key"))
    sig = nodes.select("node", "sig")
    shared = cut_lineage(meetings(keys).select(F.xxhash64("key", "head").alias("key"), "node"))
    met = cut_lineage(neighbours(shared.join(sig, "node")))
    nearest = F.min(F.struct("bits", "near")).alias("nearest")
    met_once = cut_lineage(met.groupBy("node").agg(nearest, F.sum("many").alias("many")).select("node", "nearest.*", "many"))
    crowds = cut_lineage(components(met.select(F.col("crowd").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("crowd")))
    hubs = crowds.join(met_once, "node").groupBy("crowd").agg(F.max_by("node", F.struct("many", "node")).alias("hub"), F.count("*").alias("n")).where("n > 2")
    spokes = crowds.join(hubs, "crowd").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    spokes = spokes.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    pairs = met_once.where(F.col("bits") <= BITS).select(F.col("near").alias("a"), F.col("node").alias("b")).union(close(spokes.select("a", "b", "x", "y")).select("a", "b"))
    pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    bodies, name = _bodies(known, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    stars = alike(pairs, bodies, words)
    spark.sql(f"drop table {name}")
    rooted = crowds.join(components(stars), "node", "left").select("node", "crowd", F.coalesce("root", "node").alias("part"))
    rooted = cut_lineage(rooted.join(nodes.select("node", "sig", "size"), "node"))
    dealt = deal(rooted)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            some = np.flatnonzero(_promising(block).any(axis=1))
            yield pa.RecordBatch.from_pydict({c: [v[i] for i in some] for c, v in block.items()}, schema=kinds)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            pairs = list(_linked(block, words))
            yield pa.RecordBatch.from_pydict({"a": [block["node"][i] for i, _ in pairs], "b": [block["node"][j] for _, j in pairs]}, schema=ends)

    together = ("key", "i", "j")
    kinds = to_arrow_schema(dealt.schema)
    sifted = cut_lineage(dealt.repartition(*together).sortWithinPartitions(*together).mapInArrow(sift, dealt.schema))
    bodies, name = _bodies(known, sifted.select("node").distinct())
    full = sifted.join(bodies, "node").repartition(*together).sortWithinPartitions(*together)
    pair = dealt.select(F.col("node").alias("a"), F.col("node").alias("b")).schema
    ends = to_arrow_schema(pair)
    roots = components(stars.union(full.mapInArrow(link, pair)))
    spark.sql(f"drop table {name}")
    named = nodes.select("_llm_set", "node").join(roots, "node", "left").select("_llm_set", F.coalesce("root", "node").alias("component_id"))
    return marked.select("_llm_key", "_llm_set").join(named, "_llm_set").select(F.col("_llm_key").alias(key), "component_id")


def _bodies(known: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """(node, body): the texts of the wanted nodes, each once, bucketed by node; and the table's name."""
    wanted, n = written_count(wanted)
    held = known.join(F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted, F.col("_llm_key") == F.col("node"), "left_semi")
    return bucketed(held.select(F.col("_llm_key").alias("node"), F.col("_llm_text").cast("binary").alias("body")).groupBy("node").agg(F.first("body").alias("body")), "node")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """One document of each group of `similar` ones: the one whose key names the group, with all its columns.

    Documents with a null key aren't told apart and stay; of rows repeated with one key, all stay.
    """
    groups = cut_lineage(similar(docs, key, text, **how).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_llm_gone")).distinct())
    return docs.join(groups, F.col(key) == F.col("_llm_gone"), "left_anti")
