"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from mediashelf.llm import chat, common, decontaminate, langid, mixing, repeats, sharding, simhash, topk, toxicity, urls

WORDS = "the of and tion ment alpha beta gamma delta river stone quiet garden window market simple thunder paper silver orange".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, target string, removed string, spans string, copies string, component_id string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "x", "ing", "s")) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty, blank, very long and repeated texts, repeated rows, and columns named like results."""
    rows = [
        (1, prose(1, 300), "en", "a"), (2, prose(1, 300), "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "  \n\t ", "fr", "b"), (None, prose(2, 50), "en", None),
        (6, prose(3, 40_000), "en", "a"), (7, "une é à ü ß 漢字", "fr", "é"), (8, prose(1, 299) + " other", "en", "a"), (9, "one", "en", "b"), (9, "one", "en", "b"), (None, None, None, None), (10, "\0\0 null bytes \0", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 0, *["x"] * 8) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1. mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        part, total = left, sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            out[s] += part * w[s] / total
            if out[s] >= most * sizes[s] - 1e-12:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.discard(s)
    return out


def test_targets_are_those_of_repeated_sharing(spark):
    r = random.Random(5)
    for n in (1, 2, 3, 7, 20):
        sizes = {**{f"s{i}": r.choice((0, 1, 10, 500, 10_000)) for i in range(n)}, None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {x["source"]: x["target"] for x in mixing.source_targets(df).collect()}
        for s, t in water(sizes).items():
            assert found[s] == pytest.approx(t, abs=1e-6), (sizes, s)


def test_mix_on_awkward_rows(awkward, none):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] for r in rows)
    assert {r["source"] for r in rows} == {"a", "b", "é", None}
    assert [r["size"] for r in rows if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]
    assert len({r["copies"] for r in rows if r["doc_id"] == 9}) == 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(awkward.repartition(5)).collect()))
    assert mixing.emit(mixing.mix(awkward)).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0


def test_sources_come_near_their_targets(spark):
    rows = [(i, prose(i, 5 + i % 60), f"s{i % 4}") for i in range(6000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.06)


# 2. top k


def brute_top(vectors, queries, k):
    out = set()
    for qid, q in queries:
        best = sorted((-int(np.dot(q, v)), i) for i, v in vectors if i != qid and len(v) == len(q))[:k]
        out |= {(qid, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale,dims", [(3, 2), (40, 16), (3_000_000, 8)])
def test_top_k_is_exact_with_ties_and_blocks(spark, monkeypatch, scale, dims):
    monkeypatch.setattr(topk, "BLOCK", 90)
    r = np.random.default_rng(dims)
    rows = [(i, r.integers(-scale, scale, dims).tolist()) for i in range(400)] + [(i, [scale // 2] * dims) for i in range(400, 500)] + [(600, [1])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    asked = [x for x in rows if x[0] % 25 == 0]
    found = {tuple(x) for x in topk.top_k(df, df.where("id % 25 = 0"), 5).collect()}
    assert found == brute_top(rows, asked, 5)


def test_reading_stops_before_the_lists_end():
    r = np.random.default_rng(1)
    c = np.exp(r.normal(0, 2, (4000, 3))).astype(int)
    ids, q = np.arange(4000), c[:5]
    _, row, got, score = topk.block_top(np.arange(5), q, ids, c, 3)
    want = [sorted((-int(q[i] @ v), j) for j, v in enumerate(c) if j != i)[:3] for i in range(5)]
    assert [[(-s, g) for r_, g, s in zip(row, got, score) if r_ == i] for i in range(5)] == [[(s, j) for s, j in w] for w in want]


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (50, [0.5, -0.001]), (6, [1.0, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {(x["id"], tuple(x["v"])) for x in v.collect()} == {(50, (128, -1)), (6, (256, 256))}
    assert [tuple(x) for x in topk.top_k(v, v.where("id = 50")).collect()] == [(50, 1, 6, 256 * 127)]
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0


# 3. chat


def test_control_strings_come_back(spark):
    t = chat.Template()
    bits = ["<|im_end|>", "\\", "<", "s>", "</s>", "[INST]", "[/INST]", "\n", "<|im_start|>", "é漢", "|im_end|>", "\\l", "<<SYS>>", ""]
    r = random.Random(3)
    rows = [(c, i, r.choice(("user", "assistant", "odd\nrole</s>", None)), "".join(r.choices(bits, k=6)) if r.random() < 0.9 else None) for c in range(60) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame([(*x, "x", "x") for x in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns string")
    by = defaultdict(list)
    for c, i, role, text in rows:
        by[c].append((role or "", text or ""))
    found = chat.format_conversations(df).collect()
    assert len(found) == len(by)
    for row in found:
        turns = t.parse(row["formatted"])
        assert [(a, b) for a, b, _, _ in turns] == by[row["conv_id"]]
        assert [(m["begin"], m["end"]) for m in row["loss_mask"]] == [(a, b) for role, _, a, b in turns if role == "assistant"]
        for m in row["loss_mask"]:
            assert not any(c in row["formatted"][m["begin"] : m["end"]] for c in t.controls)


def test_conversations_across_batches_and_odd_rows(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(25)] + [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, None, None), (2, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {c: r["n_turns"] for c, r in found.items()} == {1: 25, 2: 3, None: 1}
    assert found[1]["turns_sha256"] == hashlib.sha256("".join(f"user\nt{i}\n" for i in range(25)).encode()).hexdigest()
    assert found[2]["loss_chars"] == 2 and found[2]["loss_sha256"] == hashlib.sha256(b"aa").hexdigest()
    assert chat.format_conversations(df.where("false")).count() == 0


# 4. repeats


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [750_000, 300])
def test_repeats_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    r = random.Random(block)
    shared = [prose(100 + i, 60) for i in range(3)]
    texts = [prose(i, 80) + shared[i % 3][r.randint(0, 20) :] + prose(i + 50, 40) + (shared[0] if i % 5 == 0 else "") for i in range(24)]
    texts += ["ab" * 300, "a" * 500, shared[1], shared[1], "é" * 150, "", None, "short", "\0" * 450, "x" + "ab" * 101]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, removed string")
    found = [tuple(x)[1:] for x in repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()]
    assert found == brute_repeats([(t or "").encode() for t in texts], 200)


def test_repeats_of_documents(documents):
    rows = documents.orderBy("doc_id").limit(60)
    found = [tuple(x)[1:] for x in repeats.remove_repeats(rows).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()]
    assert found == brute_repeats([x["text"].encode() for x in rows.orderBy("doc_id").collect()], 200)


def test_index_has_fewer_samples_than_symbols():
    base = prose(9, 200).encode()
    texts = [base[: 400 + i] + b"%d" % i for i in range(30)]
    index = repeats.RunLengthIndex(texts)
    assert len(index.sample) < sum(map(len, texts)) / 4
    for t, r in zip(texts, index.repeats(50)):
        mine = {i for a, b in r for i in range(a, b)}
        assert mine == {i for i in range(len(t) - 49) if sum(x.count(t[i : i + 50]) for x in texts) > 1 or any(t[i : i + 50] in x for x in texts if x is not t)}


def test_repeats_on_awkward_rows(awkward, none):
    rows = repeats.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count() and all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] in (1, 2))
    assert repeats.remove_repeats(none).count() == 0


# 5. sharding


def check_shards(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in slots.items())
    where = defaultdict(set)
    for r in rows:
        where[r["text"] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_shards_are_those_of_the_heap(documents):
    rows = sharding.shard(documents, shards=7).collect()
    check_shards(rows, 7)
    groups = Counter()
    for r in rows:
        groups[hashlib.md5(r["text"].encode()).hexdigest()] += r["size"]
    heap, want = [(0, s) for s in range(7)], {}
    for g, n in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        want[g] = s
        heapq.heappush(heap, (load + n, s))
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= max(heap)[0] - min(heap)[0] + sum(groups.values()) / 7 / 50


def test_shards_of_bundles_and_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 10)
    texts = ["hot"] * 300 + [prose(i, i % 9) for i in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df, shards=4, bundles=8).collect()
    check_shards(rows, 4)


def test_shards_of_awkward_rows(awkward, none):
    rows = sharding.shard(awkward, shards=40).collect()
    assert len(rows) == awkward.count()
    check_shards(rows, 40)
    assert sharding.shard(none).count() == 0


# 6. decontamination


def test_leaks_are_found_also_reworded(spark):
    items = [(i, prose(1000 + i, 20 + 5 * i)) for i in range(8)] + [(90, None), (91, ""), (92, "?!")]
    plain = [(i, prose(i, 200)) for i in range(40)]
    leaks = []
    for i, t in items[:8]:
        w = t.split()
        reworded = [x if k % 9 else "changed" for k, x in enumerate(w)]
        leaks += [(100 + i, prose(i + 300, 70) + " " + t.upper() + " " + prose(i + 400, 50)), (200 + i, prose(i + 500, 33) + " " + " ".join(reworded)), (300 + i, t)]
    odd = [(None, items[7][1]), (400, None), (401, ""), (402, "one")]
    docs = spark.createDataFrame([(*x, "x") for x in plain + leaks + odd], "doc_id long, text string, cosine string")
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(k * 100 + i, i) for i in range(8) for k in (1, 2, 3)} | {(None, 7)}
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i, _ in plain} | {None, 400, 401, 402}
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_blocks_of_the_benchmark_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    items = [(i, prose(2000 + i, 30 + 40 * i)) for i in range(7)]
    docs = spark.createDataFrame([(i, prose(i, 20) + " " + t + " " + prose(i + 9, 20)) for i, t in items] + [(50 + i, prose(i, 150)) for i in range(20)], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, i) for i in range(7)}


def test_excerpts_of_long_items_at_all_offsets(spark):
    items = [(n, prose(3000 + n, n)) for n in (66, 95, 200)]
    docs = [(n * 1000 + at, prose(n + at, 37) + " " + " ".join(t.split()[at : at + 64]) + " " + prose(at, 50)) for n, t in items for at in range(0, n - 63)]
    found = {r["doc_id"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {i for i, _ in docs}


def test_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(50):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.longest_common(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_benchmark_passages_in_documents(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {(d["doc_id"], b["item_id"]) for d in documents.collect() for b in bench.collect() if b["text"] in d["text"]}
    assert held and held <= {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents, bench).collect()}


# 7. simhash


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, near):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if near(prints[i], prints[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_groups_are_those_of_all_pairs(spark):
    r = random.Random(8)
    prints = [0, 1, 7, 1 << 63, (1 << 64) - 1]
    for _ in range(60):
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            prints.append(p)
            for _ in range(r.randint(0, 3)):
                p ^= 1 << r.randrange(64)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "_llm_fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in common.components(simhash.links(df)).collect()}
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    groups, mine = defaultdict(set), defaultdict(set)
    for p, k in zip(prints, want):
        groups[k].add(p)
        mine[roots.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_fingerprints_and_groups_of_documents(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = simhash.near_duplicates(documents).collect()
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, want)}


def test_simhash_on_awkward_rows(awkward, none):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and {1, 3, 6, 7, 9, 10} == {r["doc_id"] for r in kept.collect()} - {None, 8} and kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.similar(none).count() == 0


def test_similar_documents_are_grouped_and_others_not(spark):
    base = [prose(i, 300).split() for i in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w[:150] + ["new"] + w[150:])) for i, w in enumerate(base)] + [(200 + i, " ".join(w[:150] + prose(i + 700, 150).split())) for i, w in enumerate(base)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {**{i: i for i in range(30)}, **{100 + i: i for i in range(30)}, **{200 + i: 200 + i for i in range(30)}}


def family(n, shared, own, seed):
    """n texts of one template: `shared` words first, then `own` words of each."""
    base = [f"s{i}" for i in range(shared)]
    return [" ".join(base + [f"{seed}o{k}x{i}" for i in range(own)]) for k in range(n)]


def test_templates_below_the_similarity_stay_apart(spark):
    texts = family(1000, 254, 50, "a")  # 250 of 350 shingles each two have in common: 0.71
    near = family(60, 284, 33, "b")  # 280 of 346: 0.81
    rows = list(enumerate(texts + near))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(1001))


def test_near_duplicates_meet_in_a_crowded_template(spark):
    texts = family(400, 284, 60, "c")  # 280 of 408 in common: 0.69
    near = [" ".join(t.split()[:-26] + [f"n{k}y{i}" for i in range(26)]) for k, t in enumerate(texts[:100])]  # 314 of 366 in common: 0.86
    ids = random.Random(1).sample(range(10_000), 500)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(zip(ids, texts + near)), "doc_id long, text string")).collect()}
    assert found == {**{i: i for i in ids[100:400]}, **{x: min(i, j) for i, j in zip(ids[:100], ids[400:]) for x in (i, j)}}


def test_recall_at_the_similarity(spark, monkeypatch):
    """Pairs at 0.80 to 0.82 among unlike documents: at least nine in ten are found (three in 1,000 are expected to be missed), also in many small blocks."""
    texts = [" ".join(f"t{k}w{i}" for i in range(304)) for k in range(300)]
    near = [" ".join([*t.split()[:271], *(f"m{k}w{i}" for i in range(33))]) for k, t in enumerate(texts)]  # 267 of 333: 0.80
    rows = [(i, t) for i, t in enumerate(texts + near)]
    for docs in (512, 3):
        monkeypatch.setattr(simhash, "BLOCK_DOCS", docs)
        found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(found[i] in (i, i % 300) for i in found) and sum(found[300 + i] == i for i in range(300)) >= 270


def test_documents_of_a_crowd_are_dealt_once_not_at_every_key(spark, monkeypatch):
    """200 texts of one template, alike in no pair, share many keys; each is one row of the comparison all the same."""
    df = spark.createDataFrame(list(enumerate(family(200, 254, 50, "d"))), "doc_id long, text string")
    plain, seen = type(df).repartition, []

    def counting(self, *by):
        if by == ("key", "i", "j"):
            seen.append(self.count())
        return plain(self, *by)

    monkeypatch.setattr(type(df), "repartition", counting)
    assert {r["component_id"] for r in simhash.similar(df).collect()} == set(range(200))
    assert 0 < seen[0] <= 200


def test_pairs_of_groups_meet_once_in_blocks(spark, monkeypatch):
    """1,000 documents of one group and 20 others: rows grow with the others' blocks, and every pair of two groups meets in one pair of blocks."""
    monkeypatch.setattr(simhash, "BLOCK_DOCS", 15)
    rows = [(i, 1, 1, b"", 10) for i in range(1000)] + [(2000 + i, 1, 2000 + i // 2, b"", 10) for i in range(20)]
    rows += [(3000, 2, 3000, b"", 10), (3001, 2, 3001, b"", 10), *((4000 + i, 3, 4000, b"", 10) for i in range(40)), *((5000 + i, 4, 5000 + i % 2, b"", 10) for i in range(4))]
    dealt = simhash.deal(spark.createDataFrame(rows, "node long, crowd long, part long, sig binary, size long")).collect()
    assert len(dealt) == 1000 * 2 + 20 * (67 + 2) + 4
    cells, met = defaultdict(list), defaultdict(int)
    for r in dealt:
        cells[r["key"], r["i"], r["j"]].append((r["node"], r["part"], r["own"]))
    for (_, i, j), held in cells.items():
        for a, p, x in held:
            for b, q, y in held:
                met[a, b] += a < b and p != q and (i == j or x != y)
    part = {r[0]: (r[1], r[2]) for r in rows}
    want = {(a, b) for a in part for b in part if a < b and part[a][0] == part[b][0] in (1, 4) and part[a][1] != part[b][1]}
    assert {p: n for p, n in met.items() if n} == dict.fromkeys(want, 1)


def test_neighbours_at_small_and_large_keys(spark):
    """Rows near another of their key, with chain, nearest and count; a key over the limit is one crowd, compared portion by portion."""
    r, limit = random.Random(12), simhash.MOST
    base = [r.getrandbits(simhash.BITS) for _ in range(3)]
    prints = [b ^ sum(1 << i for i in r.sample(range(simhash.BITS), 60)) for b in base for _ in range(4)] + [r.getrandbits(simhash.BITS)]
    raw = [p.to_bytes(simhash.BITS // 8, "little") + limit.to_bytes(8, "little") for p in prints]
    df = spark.createDataFrame([(k, n, s) for k in (1, 2) for n, s in enumerate(raw)], "key int, node int, sig binary")
    far = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    want = [(n, n // 4 * 4, min((far(n, m), m) for m in range(n // 4 * 4, n // 4 * 4 + 4) if m != n)[0], 3) for n in range(12)]
    assert sorted((x["node"], x["crowd"], x["bits"], x["many"]) for x in simhash.neighbours(df).collect()) == sorted(want * 2)
    portions = simhash.neighbours(df.where("key = 1"), most=5).collect()
    assert {x["node"] for x in portions} == set(range(13)) and {x["crowd"] for x in portions} == {0}
    assert all(x["bits"] == far(x["node"], x["near"]) <= limit if x["many"] else x["bits"] > simhash.BITS for x in portions)


def test_wide_fingerprints_and_the_keys_of_their_balls():
    """Bits are majorities of the spread hashes; keys are values of segments with some of their least sure bits flipped, the likeliest ones."""
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 4, 5, 40, 700)]
    sig, keys = simhash.signatures(sets)
    for s, word, own in zip(sets, sig, keys.tolist()):
        spread = np.unpackbits(common.mixed(s[:, None] * simhash._LANES).view(np.uint8), axis=1).astype(int).sum(axis=0)
        bits = spread * 2 > len(s)
        assert (np.unpackbits(word[:-1].view(np.uint8)) == bits).all()
        assert len(set(own)) == simhash.KEYS
        for k in own:
            first = simhash.CHECK + (k >> simhash.SEGMENT) * simhash.SEGMENT
            at = np.arange(first, first + simhash.SEGMENT)
            flipped = at[(k >> np.arange(simhash.SEGMENT) & 1) != bits[at]]
            far = np.abs(2 * spread[at] - len(s))
            assert len(flipped) <= simhash.UNSURE and (np.abs(2 * spread[flipped] - len(s)) <= np.sort(far)[simhash.UNSURE - 1]).all()


def test_similar_sets_meet_at_a_key_whatever_their_size():
    """Sets 0.8 similar, of 4 to 320 shingles: at least 97 of 100 share a key, near all are near by all bits and by the check bits; unlike sets are not."""
    r = np.random.default_rng(5)
    for both, a, b in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (40, 5, 5), (256, 32, 32)):
        pairs = [r.integers(0, 1 << 63, both + a + b, dtype=np.uint64) for _ in range(300)]
        (x, i), (y, j) = simhash.signatures([p[: both + a] for p in pairs]), simhash.signatures([np.concatenate([p[:both], p[both + a :]]) for p in pairs])
        assert sum(bool(set(p) & set(q)) for p, q in zip(i.tolist(), j.tolist())) >= 291
        assert simhash.differing(x, y)[1].sum() >= 298 and (np.bitwise_count(x[:, 0] ^ y[:, 0]) <= simhash.NEAR).sum() >= 298
        assert not simhash.differing(x, np.roll(y, 1, axis=0))[1].any()


def test_meetings_are_those_of_all_pairs(spark):
    """Rows near another of their key, with the first of their chain; crowded keys whole; also across batches."""
    r, rows = random.Random(6), []
    for key in range(400):
        checks = [r.getrandbits(64) for _ in range(3)]
        rows += [(key, r.choice(checks) ^ sum(1 << i for i in r.sample(range(64), 9))) for _ in range(r.choice((1, 2, 5, 20, simhash.CROWD)))]
    rows += [(500, r.getrandbits(64)) for _ in range(300)]
    rows = [(key, node, check) for node, (key, check) in enumerate(r.sample(rows, len(rows)))]
    want = {(500, min(n for k, n, _ in rows if k == 500), n) for k, n, _ in rows if k == 500}
    for key in range(400):
        own = [(n, c) for k, n, c in rows if k == key]
        found = brute_components([c for _, c in own], lambda a, b: (a ^ b).bit_count() <= simhash.NEAR)
        want |= {(key, own[g][0], n) for (n, _), g in zip(own, found) if found.count(g) > 1}
    keys = spark.createDataFrame([(k, n, c - (1 << 64) if c >> 63 else c) for k, n, c in rows], "key int, node long, check long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(x) for x in simhash.meetings(keys).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5000), (None, 1), (2000, 1000)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(501)}, 1000: 1000, **{2000 + i: 1000 for i in range(300)}}


# 8. language


def test_held_out_languages(documents):
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.fit(documents, where=part != 1)
    rows = langid.classify(documents.where(part == 1), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_spans_of_mixed_text_and_scripts(spark, documents):
    russian = [(f"{t} это русский текст про дом и лес", "ru") for t in ("мама", "папа", "вода", "река", "поле")]
    model = langid.fit(documents.select("text", "lang").union(spark.createDataFrame(russian, "text string, lang string")))
    texts = {x: documents.where(F.col("lang") == x).orderBy("doc_id").head()["text"][:400].rsplit(" ", 1)[0] for x in ("en", "de")}
    mixed = f"{texts['en']} {texts['de']} мама это лес и дом".encode()
    found = langid.spans([mixed], model)[0]
    assert [x[2] for x in found] == ["en", "de", "ru"]
    assert abs(found[0][1] - len(texts["en"].encode())) < 25
    name, score = langid.predict([mixed, "лес и дом".encode(), b"", b"12 34 !", "漢字".encode()], model)
    assert name[1] == "ru" and name[2:4] == ["und", "und"] and name[4] != "und" and 0 < score[0] < 1


def test_viterbi_is_that_of_all_paths():
    r = np.random.default_rng(4)
    for _ in range(60):
        lengths = r.integers(0, 7, 3)
        first = np.concatenate(([0], np.cumsum(lengths)))
        score = r.normal(0, 2, (first[-1], 3)).astype(np.float32)
        mine = langid.viterbi(score, first, 1.5)
        for a, b in zip(first[:-1], first[1:]):
            value = lambda p: sum(score[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
            assert value(mine[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))), abs=1e-4)


def test_language_on_awkward_rows(awkward, none):
    model = langid.fit(awkward)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward, langid.fit(none)).collect()} == {"und"}


# 9. urls


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/"), "https://example.org": ("example.org", "", None),
        "http://x.org/": ("x.org", "/", "org/"), "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1"), "http://a.com/fr/": ("a.com", "/fr/", "com/fr/"), "http://acom/fr/": ("acom", "/fr/", None),
        "x://b.com/de/?q=://z.org/": ("b.com", "/de/", "com/de/"), "http://?q": ("", "", None), "http://com/de/\n1": ("com", "/de/\n1", "com/de/"), "http://Ärger.org/": ("Ärger.org", "/", "org/"),
    }
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(df).collect()}
    assert found == dict(enumerate(cases.values()))
    assert urls.judge(df.where("false")).count() == 0


def test_names_are_split_into_words(spark):
    words = spark.createDataFrame([("free", 50), ("bets", 30), ("be", 90), ("the", 500), ("river", 20), ("fre", 1), ("side", 9), ("riverside", 1)], "word string, n long")
    names = spark.createDataFrame([("freebets",), ("theriver",), ("xqz",), ("freexqz",), ("a" * 300,)], "name string")
    found = {r["name"]: list(r["parts"]) for r in urls.segment(names, words).collect()}
    assert found == {"freebets": ["free", "bets"], "theriver": ["the", "river"], "xqz": ["xqz"], "freexqz": ["free", "xqz"], "a" * 300: ["a" * 300]}


def test_split_is_the_best_of_all():
    r = random.Random(6)
    logp = {w: -r.uniform(1, 9) for w in ("a", "b", "ab", "ba", "aba", "bb", "abab")}
    for _ in range(40):
        name = "".join(r.choices("abc", k=r.randint(1, 9)))
        found = [(i, n, logp[name[i : i + n]]) for i in range(len(name)) for n in range(1, 5) if name[i : i + n] in logp and i + n <= len(name)]
        cost = lambda parts: sum(logp.get(p, -urls.UNKNOWN * len(p)) for p in parts)
        ways = [[name[a:b] for a, b in zip((0, *cut), (*cut, len(name)))] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)]
        assert cost(urls.best_split(name, found)) == pytest.approx(max(map(cost, ways)))


def test_marked_hosts_and_their_like_are_blocked(spark):
    rows = [(i, f"http://www.free-casino{i % 5}.net/win/{i}", None) for i in range(20)] + [(100 + i, f"http://{WORDS[i % 9]}.net/en/{i}", "<p>casino win the free river</p>") for i in range(60)] + [(500, "http://casinowin.net/x", None)]
    found = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == "block" for i in [*range(20), 500]) and all(found[100 + i] == "allow" for i in range(60))


# 10. toxicity


def toxic_rows(n):
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(n):
        text = prose(i, 60)
        toxic = i % 8 == 0
        rows.append((i, f"{text} {bad[i % 3] if toxic else 'kind'} {prose(i + 5000, 20)}"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def judge(spark):
    rows, labels = toxic_rows(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_obfuscated_words_are_read(judge):
    bad = ["you 1d10t there", "such a m0r0n", "a m o r o n he is", "s.c.u.m of it", "idiooooot", "I D I O T", "$cum again", "plain moron", "MORON!"]
    good = ["you are kind", "", "the 1st of 20 rooms", "a b c", "see www.garden.net", "aaaa", "soooo quiet", "call 555-3752"]
    assert (judge.scores([f"{prose(1, 30)} {x} {prose(2, 30)}".encode() for x in bad]) >= 0.5).all()
    assert (judge.scores([x.encode() for x in good]) < 0.5).all()


def test_scores_dont_depend_on_neighbours(judge):
    texts = [b"x idi", b"ot y", b"moron", b"", b"  sc", b"um"]
    assert judge.scores(texts).tolist() == [judge.scores([t])[0] for t in texts]
    assert (judge.scores(texts) >= 0.5).tolist() == [False, False, True, False, False, False]


def test_decoding_is_the_best_of_all_readings(judge):
    channel = judge.channel
    cost = channel.cost

    def worth(word, extra):
        a = b = 0
        for ch in word:
            extra += cost[a][b][ord(ch) - 96]
            a, b = b, ord(ch) - 96
        return extra + cost[a][b][0]

    for seen in ("1d1ot", "m0ron", "ki11nd", "5cum"):
        ways = [[(seen[i], 0.0)] if seen[i].isalpha() else [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET[seen[i]]] for i in range(len(seen))]
        ways = [w + ([("", toxicity.REPEAT)] if i and seen[i - 1] == seen[i] else []) for i, w in enumerate(ways)]
        best = min(worth("".join(x for x, _ in p), sum(c for _, c in p)) for p in itertools.product(*ways))
        found = channel.decode(seen)
        assert min(worth("".join(x for x, _ in p), sum(c for _, c in p)) for p in itertools.product(*ways) if "".join(x for x, _ in p) == found) == pytest.approx(best)


def test_held_out_labels(spark):
    rows, labels = toxic_rows(400)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0, None), (None, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    found = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, marks, where=part != 0).where(part == 0).collect()}
    assert found == {i: t for i, _, t in labels if i in found} and sum(found.values()) > 3


@pytest.mark.parametrize("seen", ["mo.ron", "morron", "m o r", "m 0 r 0 n", "m0 ron m o r o n", "a$$", "as$", "." .join(["word"] * 60 + ["moron"]) + "_m_o_r_o_n", "x" * 300 + ".m0ron"])
def test_weak_obfuscation_reaches_the_decoder(seen):
    counts = np.zeros((27, 27, 27))
    for word in ["moron"] * 50 + ["mor"] * 20 + ["ass"] * 50 + ["word"] * 20:
        c = [0, 0, *(ord(x) - 96 for x in word), 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            counts[a, b, d] += 1
    read = toxicity.restored([b"one two", seen.encode(), b"three"], toxicity.Channel(counts))
    assert read[0] == b"one two" and read[2].startswith(b"three")
    assert ("ass" if "$" in seen else "mor" if seen == "m o r" else "moron") in read[1].decode().split()


def test_toxicity_on_awkward_rows(awkward, none, spark):
    labels = spark.createDataFrame([(1, 1, 1), (None, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(none, labels).count() == 0
    assert all(r["score"] < 0.01 for r in toxicity.scored(awkward, labels.where("false")).collect())
