"""Periodic runs, substring dedup and whitening against brute force, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from mediashelf.llm import automata, queries, runs, whitening

EXTRA = "runs string, n_words string, removed string, n_removed string, kept string, body string, key string, piece string"


def table(spark, texts):
    """(doc_id, text) with columns named like results and like what operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in texts], "doc_id long, text string, " + EXTRA)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, "b " * 40), (5, "b " * 40), (5, "b " * 40), (6, "é 漢字   x " * 9), (7, " ".join(map(str, range(30_000)))), (None, None)]


# 11. periodic runs


def all_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("portion", [1_000_000, 29])
def test_runs_are_those_of_all_periods(monkeypatch, portion):
    monkeypatch.setattr(runs, "PAIRS", portion)
    r = random.Random(portion)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(0, 6)):
            n, k = r.choice([0, 1, 2, 5, 12, 30, 100, 300]), r.choice([1, 2, 3, 20])
            t = [r.randrange(k) for _ in range(n)]
            if n > 20 and r.random() < 0.7:
                a = r.randrange(n)
                p = 1 + r.randrange((n - a) // 2 + 1)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
                if r.random() < 0.4:
                    t[r.randrange(n)] = r.randrange(k + 1)
            texts.append(t)
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        words = np.array([x for t in texts for x in t], np.int64)
        assert [tuple(x) for x in runs.runs_of(words, first).tolist()] == [(i, *x) for i, t in enumerate(texts) for x in all_runs(t)]


def test_extensions_are_those_of_a_word_by_word_comparison():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 2, n) for n in (0, 1, 90, 3, 200)] + [np.zeros(70, np.int64)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words = np.concatenate(texts)
    pairs = [(a, b) for s, e in zip(first, first[1:], strict=False) for a in range(s, e) for b in range(a + 1, e + 1)]
    a, b = np.array(pairs).T
    end = first[np.searchsorted(first, a, side="right")]
    expected = [next((i for i in range(e - y) if words[x + i] != words[y + i]), e - y) for x, y, e in zip(a, b, end, strict=True)]
    index = runs.CoverIndex(words, first)
    assert index.extension(a, b).tolist() == expected
    assert len(index.rank) < len(words) / 2  # of all suffixes only the cover's are sorted


def test_the_cover_has_every_difference():
    assert {(x - y) % runs.CYCLE for x in runs.COVER for y in runs.COVER} == set(range(runs.CYCLE))


def test_runs_of_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    got = runs.find_runs(docs)
    assert runs.find_runs(docs.where("false")).count() == 0
    assert {"key", "body", "piece", "kept"} <= set(got.columns) and got.schema["n_words"].dataType.simpleString() == "bigint"
    rows = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got.collect())
    expected = Counter()
    for i, t in AWKWARD:
        w = [x.decode() for x in (t or "").encode().split()]
        found = all_runs(w) if len(w) < 1000 else []
        expected[i, len(w), tuple(found), collapsed(w, found)] += 1
    assert rows == expected


def test_query_of_runs(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tailed = 0
    for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect():
        w = [x.decode() for x in (docs.pop(r["doc_id"]) or "").encode().split()]
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, tailed = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], tailed + 1
        if n > 3000:
            continue  # plain comparison is quadratic
        found = all_runs(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *told)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert not docs and tailed > 5


# 12. substring dedup


def without_repeats(texts, window=35):
    split = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        yield len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


@pytest.mark.parametrize(("shard", "broadcast"), [(300_000, 16_000_000), (300_000, 0), (900, 16_000_000), (900, 0)])
def test_repeated_windows_are_taken_out(spark, monkeypatch, shard, broadcast):
    """Broadcast and shuffled automata, many shards and crowded anchors."""
    monkeypatch.setattr(automata, "SHARD_BYTES", shard)
    monkeypatch.setattr(automata, "CROWDED_BYTES", shard)
    monkeypatch.setattr(automata, "BROADCAST_BYTES", broadcast)
    r = random.Random(shard)
    word = lambda: r.choice("abcdefghij") * r.randint(1, 3)
    shared = [[word() for _ in range(n)] for n in (35, 36, 60, 34, 500)]
    texts = []
    for i in range(60):
        t = [word() for _ in range(r.randrange(90))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t[at:at] = r.choice(shared)
        texts.append(" ".join(t))
    texts += [texts[0], "x y " * 300, "z " * 36, "z " * 35, "q  " * 36, " ".join(["deep"] * 5 + [str(i) for i in range(2000)] * 2)]
    docs = table(spark, enumerate(texts))
    rows = sorted(automata.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "removed").collect())
    assert [r[1:4] for r in rows] == list(without_repeats(texts))
    for r in rows:
        assert sum(x["b"] - x["a"] for x in r["removed"] or []) == r["n_removed"]


def test_crowds_of_near_copies_are_cut_at_longer_anchors(spark, monkeypatch):
    """Copies that differ by a word each: fewer windows are left for their digests than the crowded pieces have."""
    counted, window_rows = automata._counted, []

    def count(cuts, window):
        window_rows.append(cuts.select(F.explode("ps").alias("p")).where("p.shard is null").agg(F.sum("p.n")).head()[0])
        return counted(cuts, window)

    monkeypatch.setattr(automata, "CROWDED_BYTES", 20_000)
    monkeypatch.setattr(automata, "_counted", count)
    r = random.Random(12)
    base, texts = [f"w{r.randrange(10**6)}" for _ in range(120)], []
    for i in range(400):
        t = list(base)
        for at in r.sample(range(120), r.choice((0, 1, 1, 2))):
            t[at] = f"other{i}"
        texts.append(" ".join(t))
    rows = sorted(automata.remove_repeats(table(spark, enumerate(texts))).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert [r[1:4] for r in rows] == list(without_repeats(texts))
    assert sum(window_rows) < 1_000


def test_automaton_keeps_what_occurs_twice():
    r = random.Random(4)
    for _ in range(50):
        pieces = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(25))] for _ in range(4)]
        times = Counter(tuple(p[i:j]) for p in pieces for i in range(len(p)) for j in range(i + 1, len(p) + 1))
        held = automata.Automaton(pieces)
        for window in (1, 3, 6):
            for p in pieces:
                starts = {i for a, b in held.repeats(p, window) for i in range(a, b)}
                assert starts == {i for i in range(len(p) - window + 1) if times[tuple(p[i : i + window])] > 1}


def test_substrings_of_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    got = automata.remove_repeats(docs)
    assert automata.remove_repeats(docs.where("false")).count() == 0 and {"key", "body", "kept", "piece", "runs"} <= set(got.columns)
    plain = list(without_repeats([t for _, t in AWKWARD]))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == Counter((i, *x) for (i, _), x in zip(AWKWARD, plain, strict=True))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_")]


# 13. whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, n string, component string")


def test_polynomial_is_that_of_exact_minors(spark):
    """Faddeev and LeVerrier's recurrence in whole numbers, on matrices with zero pivots and large entries."""
    r = random.Random(3)
    for d, top in ((1, 9), (2, 5), (6, 3), (9, 10**12)):
        b = [[r.choice([0, r.randrange(-top, top + 1)]) for _ in range(d)] for _ in range(d)]
        a = [[sum(b[k][i] * b[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        m, c = [[0] * d for _ in range(d)], [1]
        for k in range(1, d + 1):
            m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
            c.append(-sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) // k)
        assert whitening.characteristic_polynomial(spark, a) == c[::-1]


def test_roots_are_isolated_also_multiple_and_zero():
    def expand(roots):
        c = [1]
        for x in roots:
            c = [(c[i - 1] if i else 0) - x * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        return c

    for roots in ([5], [0, 0, 7], [1, 2, 3, 1000], [4, 4, 4, 9], [10**15, 10**15 + 1, 3], [0, 0]):
        told = [(x >> 20) + (x & (1 << 20) - 1 > 1 << 19) for x, m in whitening.largest_roots(expand(roots), 10, 20) for _ in range(m)]
        assert told == sorted((x for x in roots if x), reverse=True)
    irrational = whitening.largest_roots([1, -3, 1], 1, 64)[0][0] / 2**64  # (3 + sqrt(5)) / 2
    assert abs(irrational - (3 + 5**0.5) / 2) < 1e-15


def test_whitening_is_that_of_the_eigenvectors(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = queries.QUERIES["op13_whiten"](spark, SF).collect()
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in r["embedding"]] for r in source.orderBy("vec_id").collect()])
    n = len(x)
    values, directions = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    plain = (x - x.mean(axis=0)) @ directions[:, :-9:-1] / np.sqrt(values[:-9:-1])
    ours = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))]).reshape(n, 8)
    assert np.abs(ours * np.sign((ours * plain).sum(axis=0)) - plain).max() < 1e-8
    far = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    for r in rows:
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] / (values[-r["component"]] / values.sum()) - 1) < 1e-9
    assert [r["deviation"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == 1] == far


def test_whitening_of_awkward_vectors(spark):
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 0.0, 0.0]), (93, [float("inf"), 0.0, 0.0]), (94, [1e300, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [])]
    good = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (None, [2.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [5.0, 5.0, 0.0])]
    rows = whitening.whiten(whitening.quantised(vectors(spark, bad + good))).collect()
    assert Counter(r["vec_id"] for r in rows) == Counter({1: 2, 2: 4, None: 2, 3: 2})  # the third direction has no variance
    assert {r["component"] for r in rows} == {1, 2} and all(r["n"] == 5 and r["identity_error"] < 1e-12 for r in rows)
    assert abs(sum({r["component"]: r["explained"] for r in rows}.values()) - 1) < 1e-12
    for nothing in (bad[:5], [], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whiten(whitening.quantised(vectors(spark, nothing))).collect() == []


def test_equal_eigenvalues_and_large_numbers(spark):
    square = [(i, [a * 1e12, b * 1e12]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    rows = whitening.whiten(whitening.quantised(vectors(spark, square))).collect()
    assert len(rows) == 8 and all(abs(r["explained"] - 0.5) < 1e-12 and r["identity_error"] < 1e-12 and r["deviation"] is None for r in rows)


def test_products_are_exact_at_any_size():
    for top in (5, 1 << 27, 1 << 45):
        y = np.random.default_rng(1).integers(-top, top, (30, 3))
        exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening._products(y).tolist() == exact


# earlier operators, with awkward columns


def test_repeats_with_columns_named_like_inner_ones(spark):
    from mediashelf.llm import repeats

    docs = table(spark, AWKWARD)
    got = repeats.remove_repeats(docs)
    assert {"key", "body", "kept", "piece", "runs"} <= set(got.columns) and got.count() == len(AWKWARD)
    assert {r["n_removed"] for r in got.collect() if r["doc_id"] in (1, 2, 3, 4)} == {0}


def test_items_of_any_integer_type(spark):
    from mediashelf.llm import decontaminate

    text = " ".join(f"w{i}" for i in range(40))
    docs = table(spark, [(1, f"before {text} after"), (2, "nothing of the kind")])
    for kind in ("int", "long", "short"):
        found = decontaminate.contaminated(docs, spark.createDataFrame([(7, text)], f"item_id {kind}, text string"))
        assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, 7)]
