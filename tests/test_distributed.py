"""Distributed operators against the plain sequential or brute-force answer on small data."""

import difflib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from mediashelf.functions import text as tx
from mediashelf.operators import faces as fc
from mediashelf.operators import bm25, documents, geocode, ingest, people, understand
from mediashelf.operators import vector_search as vs
from mediashelf.operators.library import list_files
from mediashelf.plans.library_views import stream_view
from mediashelf.session import cut_lineage
from mediashelf.sources import sinks
from mediashelf.streaming import streams as st


def unit(rng, n, d=8):
    v = rng.standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


# ---------------------------------------------------------------- faces
def sequential_faces(new, known, threshold, topn):
    """One face after the other, as a single process would do it."""
    index = [(f"k:{f}", u, file, p, np.array(v)) for u, file, f, p, v in known]
    out = {}
    files = sorted({(u, seq, file) for u, file, seq, *_ in new})
    for u, _, file in files:
        index = [r for r in index if not (r[1] == u and r[2] == file)]
        used = set()
        photo = sorted((r for r in new if r[0] == u and r[1] == file), key=lambda r: (-r[4], r[3]))
        for _, _, _, fid, _, v in photo:
            near = sorted(((round(float(np.dot(v, r[4])), 9), r[0], r[3]) for r in index if r[1] == u), key=lambda x: (-x[0], x[1]))
            person = next((p for c, _, p in near[:topn] if c >= threshold and p not in used), None)
            if person is None:
                import hashlib

                person = "p-" + hashlib.sha256(str(fid).encode()).hexdigest()[:32]
            used.add(person)
            out[fid] = person
            index.append((f"n:{fid}", u, file, person, np.array(v)))
    return out


@pytest.mark.parametrize("seed,threshold,topn", [(1, 0.3, 5), (2, 0.6, 5), (3, 0.1, 2)])
def test_faces_equal_the_sequential_run(spark, seed, threshold, topn):
    rng = np.random.default_rng(seed)
    vec = unit(rng, 150, 5).round(6).tolist()
    known = [(i % 2, i % 9, 1000 + i, f"old{i % 4}", vec[i]) for i in range(30)]
    new = [(i % 2, (i * 7) % 20, (i * 7) % 20, i, float(rng.integers(0, 5)) / 5, vec[i]) for i in range(30, 150)]
    want = sequential_faces(new, known, threshold, topn)
    n = spark.createDataFrame(new, "user_id int, file_id int, file_seq int, face_id int, score double, embedding array<double>")
    k = spark.createDataFrame(known, "user_id int, file_id int, face_id int, person_id string, embedding array<double>")
    got = {r.face_id: r.person_id for r in fc.assign_faces(n, k, threshold, topn).collect()}
    assert got == want
    assert len(set(want.values())) > 5


# ---------------------------------------------------------------- vectors
def test_both_search_plans_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x, q = unit(rng, 300), unit(rng, 12)
    x[100:200] = x[0]  # a third of the rows are copies
    index = [(0 if i % 3 else 1, "m", f"h{i:03d}", x[i].tolist()) for i in range(300)]
    asked = [(i, i % 2, "m", q[i].tolist(), i % 4 == 0) for i in range(12)]
    allow = [(i, f"h{j:03d}") for i in range(12) for j in range(0, 300, i + 2)]
    di = spark.createDataFrame(index, "user_id int, embed_model string, file_hash string, embedding array<double>")
    dq = spark.createDataFrame(asked, "query_id int, user_id int, embed_model string, embedding array<double>, filtered boolean")
    da = spark.createDataFrame(allow, "query_id int, file_hash string")
    ok = set(allow)
    want = set()
    for i, user, _, v, filtered in asked:
        rows = [(-round(float(np.dot(v, e)), 9), h) for u, _, h, e in index if u == user and (not filtered or (i, h) in ok)]
        want |= {(i, h, r) for r, (_, h) in enumerate(sorted(rows)[:7], 1)}
    for found in (
        vs.vector_search(dq, di, 7, allow=da),
        vs.vector_search(dq, di, 7, allow=da, small_batch=0),
        vs.top_k(vs.search_blocks(dq, di, 7, vs.SPACE, allow=da, block_rows=20, block_queries=2), ["query_id"], [F.desc("cos"), F.asc("file_hash")], 7, rank="rank"),
    ):
        assert {(r.query_id, r.file_hash, r.rank) for r in found.collect()} == want


def test_approximate_search_finds_most(spark):
    rng = np.random.default_rng(9)
    x = unit(rng, 500, 16)
    q = x[:20] + 0.15 * rng.standard_normal((20, 16))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    di = spark.createDataFrame([(1, "m", f"h{i}", v.tolist()) for i, v in enumerate(x)], "user_id int, embed_model string, file_hash string, embedding array<double>")
    dq = spark.createDataFrame([(i, 1, "m", v.tolist()) for i, v in enumerate(q)], "query_id int, user_id int, embed_model string, embedding array<double>")
    got = {(r.query_id, r.file_hash) for r in vs.vector_search_approx(dq, di, 1).collect()}
    best = {(i, f"h{int(np.argmax(x @ v))}") for i, v in enumerate(q)}
    assert len(got & best) >= 18


def test_approximate_search_on_ordinary_queries(spark):
    rng = np.random.default_rng(10)
    x, q = unit(rng, 800, 32), unit(rng, 40, 32)
    di = spark.createDataFrame([(i % 2, "m", f"h{i}", v.tolist()) for i, v in enumerate(x)] + [(7, "m", "only", x[0].tolist())], "user_id int, embed_model string, file_hash string, embedding array<double>")
    dq = spark.createDataFrame([(i, i % 2, "m", v.tolist()) for i, v in enumerate(q)] + [(99, 7, "m", q[0].tolist())], "query_id int, user_id int, embed_model string, embedding array<double>")
    got = {(r.query_id, r.file_hash) for r in vs.vector_search_approx(dq, di, 10).collect()}
    want = {(r.query_id, r.file_hash) for r in vs.vector_search(dq, di, 10).collect()}
    assert len(got) == len(want) == 401 and len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_query_ids_keep_their_type(spark, kind):
    di = spark.createDataFrame([(1, "m", "h", [1.0, 0.0])], "user_id int, embed_model string, file_hash string, embedding array<double>")
    dq = spark.sql(f"select cast(5 as {kind}) as query_id, 1 as user_id, 'm' as embed_model, array(1d, 0d) as embedding")
    for small in (0, 100):
        found = vs.vector_search(dq, di, 3, small_batch=small)
        assert dict(found.dtypes)["query_id"] == kind and found.count() == 1


def test_keywords_from_prepared_tables(spark, lib):
    keys = ["file_hash", "chunk"]
    index = tuple(map(cut_lineage, bm25.bm25_index(lib("passages"), bm25.TITLE_AND_TEXT, ["user_id", *keys])))
    found = bm25.bm25_search(lib("keyword_queries"), index, bm25.TITLE_AND_TEXT, keys, n=40)
    want = bm25.bm25_search(lib("keyword_queries"), lib("passages"), bm25.TITLE_AND_TEXT, keys, n=40)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert "documents.parquet" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_a_keyword_search_move_once(spark, lib):
    """Postings are counted, weighed and summed where their document is; rows of one document at several places are one."""
    keys = ["file_hash", "chunk"]
    docs = lib("passages").select("user_id", *keys, "title", "text")
    found = bm25.bm25_search(lib("keyword_queries"), docs, bm25.TITLE_AND_TEXT, keys)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not re.search(r"hashpartitioning\([^)]*file_hash[^)]*(term|query_id)|hashpartitioning\([^)]*query_id[^)]*file_hash", plan)
    rows = [(1, "a", 0, "x", "red blue red"), (1, "a", 0, "x", "blue red red"), (1, "b", 0, "", "red"), (1, "c", 0, None, None)]
    twice = spark.createDataFrame(rows, "user_id int, file_hash string, chunk int, title string, text string").repartition(4)
    _, df, p = bm25.bm25_index(twice, bm25.TITLE_AND_TEXT, ["user_id", *keys])
    assert {tuple(r) for r in df.collect()} == {(1, "x", 1), (1, "red", 2), (1, "blue", 1)}
    assert {(r.file_hash, r.term, r.tf0, r.tf1) for r in p.collect()} == {("a", "x", 2, 0), ("a", "red", 0, 4), ("a", "blue", 0, 2), ("b", "red", 0, 1)}


def test_passages_of_candidates_are_fetched_without_a_shuffle_of_texts(spark, lib):
    from mediashelf.plans.search import document_hits

    asked = lib("keyword_queries").join(lib("embeddings").selectExpr("vec_id as query_id", "embedding"), "query_id").withColumn("filtered", F.lit(False))
    hits = document_hits(asked, lib("passages"), 10, None, min_cos=0.2, good_cos=0.25, strong_cos=0.3, window=0.15)
    assert not re.search(r"hashpartitioning\([^)]*pid", hits._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- names
def test_similar_words_equal_all_pairs(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    words += ["".join(rnd.choice("abz1é") for _ in range(rnd.randint(1, 5))) for _ in range(200)] + ["añb", "zz", "z+", "+z1"]
    rnd.shuffle(words)
    left, right = sorted(set(words[:200])), sorted(set(words[150:]))
    dl = spark.createDataFrame([(1, w) for w in left], "user_id int, lword string")
    dr = spark.createDataFrame([(1, w) for w in right], "user_id int, rword string")
    got = {(r.lword, r.rword) for r in understand.similar_words(dl, dr).collect()}
    want = {(a, b) for a in left for b in right if a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.75}
    assert got == want and len(want) > 40
    keys = spark.createDataFrame([(w,) for w in left], "w string").select("w", understand._rare_pairs(F.col("w")).alias("k")).collect()
    assert all(len(k) in (1, 3, 6) and all(len(x) == 3 for x in k) for w, k in keys if 2 <= len(w) <= 5)  # never a single letter


# ---------------------------------------------------------------- geography
def test_nearest_city_equals_all_pairs(spark):
    rnd = random.Random(11)
    cities = [(i, f"c{i}", rnd.uniform(-89, 89), rnd.uniform(-180, 180), rnd.randint(0, 3_000_000), f"r{i % 7}", f"k{i % 5}") for i in range(120)]
    cities += [(200 + i, f"d{i}", 19 + rnd.uniform(-0.2, 0.2), 179.95 + rnd.uniform(-0.2, 0.05), 10 ** rnd.randint(3, 7), "pacific", "k") for i in range(15)]
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(150)]
    pts += [(200 + i, 19 + rnd.uniform(-0.4, 0.4), rnd.choice([-179.98, 179.9, 180.0, -180.0])) for i in range(40)] + [(300, 90.0, 0.0), (301, -90.0, 12.0)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    want = {}
    for pid, lat, lon in pts:
        near = sorted((km(lat, lon, c[2], c[3]), c[0], c) for c in cities)
        dist, _, first = near[0]
        city, area = (first[1] if dist <= 40 else None), None
        big = max((c for d, _, c in near if d <= 25), key=lambda c: (c[4], -c[0]), default=None)
        if city and big and big[0] != first[0] and big[4] >= 500_000 and big[4] >= 5 * max(first[4], 1):
            area, city = first[1], big[1]
        want[pid] = (area, city, first[5] if dist <= 160 else None, first[6])
    dc = spark.createDataFrame(cities, "city_id int, name string, lat double, lon double, population int, region string, country string")
    dp = spark.createDataFrame(pts, "id int, lat double, lon double")
    rows = geocode.reverse_geocode(dp, dc).collect()
    assert {r.id: (r.place_area, r.place_city, r.place_region, r.place_country) for r in rows} == want
    assert any(v[0] for v in want.values())


def test_a_gazetteer_of_any_size(spark):
    """300,000 cities, half of them in one hot region: the same as all pairs, by joins that ship no table of cities on request."""
    rng = np.random.default_rng(5)
    n = 300_000
    lat = np.concatenate([rng.uniform(-89, 89, n // 2), rng.normal(48, 0.5, n - n // 2)])
    lon = np.concatenate([rng.uniform(-180, 180, n // 2), rng.normal(2, 0.7, n - n // 2)])
    population = 10 ** rng.integers(2, 8, n)
    cities = pd.DataFrame({"city_id": np.arange(n), "name": [f"c{i}" for i in range(n)], "lat": lat, "lon": lon, "population": population, "region": [f"r{i % 7}" for i in range(n)], "country": [f"k{i % 5}" for i in range(n)]})
    m = 120
    points = pd.DataFrame({"id": np.arange(m), "lat": np.append(rng.uniform(-90, 90, m - 41), [*rng.normal(48, 0.5, 40), 90.0]), "lon": np.append(rng.uniform(-180, 180, m - 41), [*rng.normal(2, 0.7, 40), 7.0])})
    found = geocode.reverse_geocode(spark.createDataFrame(points), spark.createDataFrame(cities))
    assert "ResolvedHint" not in found._jdf.queryExecution().analyzed().toString()
    rows = {r.id: r for r in found.collect()}
    a, b = np.radians(lat), np.radians(lon)
    for i, y, x in zip(points["id"], np.radians(points["lat"]), np.radians(points["lon"]), strict=True):
        km = 2 * 6371.0 * np.arcsin(np.sqrt(np.sin((a - y) / 2) ** 2 + np.cos(a) * np.cos(y) * np.sin((b - x) / 2) ** 2))
        first = int(km.argmin())
        close = np.flatnonzero(km <= 25)
        big = int(close[np.lexsort((close, -population[close]))[0]]) if len(close) else first
        metro = km[first] <= 40 and big != first and population[big] >= 500_000 and population[big] >= 5 * max(population[first], 1)
        city = (f"c{big}" if metro else f"c{first}") if km[first] <= 40 else None
        assert (rows[i].place_area, rows[i].place_city, rows[i].place_region, rows[i].place_country) == (f"c{first}" if metro else None, city, f"r{first % 7}" if km[first] <= 160 else None, f"k{first % 5}")
    assert sum(r.place_area is not None for r in rows.values()) > 5
    nowhere = geocode.reverse_geocode(spark.createDataFrame(points.head(3)), spark.createDataFrame(cities.head(1)).where("false")).collect()
    assert [r.place_name for r in nowhere] == [None] * 3


def test_dense_cities_settle_points_at_all_latitudes(spark, monkeypatch):
    """In a dense gazetteer of few coordinates no point goes on to the coarse cells, and cities of one coordinate are one place."""
    rng = np.random.default_rng(6)
    at = [(y, x) for y in range(-84, 88, 3) for x in range(-180, 180, 12 if abs(y) < 60 else 45)]
    at += [(y + dy, x + dx) for y, x in ((82, 10), (-70, -180), (66, 179.8), (5, 40)) for dy in (0, 0.1, 0.2) for dx in (0, 0.05, 0.09)]
    rows = [(7 * i % 4001, f"c{7 * i % 4001}", float(at[i % len(at)][0]), float(at[i % len(at)][1]), int(10 ** rng.integers(3, 8)), f"r{i % 7}", f"k{i % 5}") for i in range(4001)]
    cities = spark.createDataFrame(rows, "city_id int, name string, lat double, lon double, population int, region string, country string")
    points = [(i, y + 0.06, x + 0.013) for i, (y, x) in enumerate(at[-36:])]
    seen = {"far": 0, "held": 0}
    far, arrays = geocode._far, geocode._arrays
    monkeypatch.setattr(geocode, "DENSE_FROM", 100)
    monkeypatch.setattr(geocode, "_far", lambda rest, places: (seen.update(far=rest.count()), far(rest, places))[1])
    monkeypatch.setattr(geocode, "_arrays", lambda placed: (seen.update(held=max(seen["held"], placed.count())), arrays(placed))[1])
    for chunk in (2_000, 2):
        monkeypatch.setattr(geocode, "CHUNK", chunk)
        found = geocode.reverse_geocode(spark.createDataFrame(points, "id int, lat double, lon double"), cities).collect()
        assert len(found) == len(points) and seen["far"] == 0 and seen["held"] <= 9 * len(at)
        for r in found:
            _, y, x = points[r.id]
            close = []
            for c in rows:
                a, b, e, f = map(math.radians, (y, x, c[2], c[3]))
                h = math.sin((e - a) / 2) ** 2 + math.cos(a) * math.cos(e) * math.sin((f - b) / 2) ** 2
                close.append((round(2 * 6371.0 * math.asin(math.sqrt(h)), 6), c[0], c))
            km, _, first = min(close)
            big = max((c for d, _, c in close if d <= 25), key=lambda c: (c[4], -c[0]))
            metro = big[0] != first[0] and big[4] >= 500_000 and big[4] >= 5 * first[4]
            assert km < 25 and (r.place_area, r.place_city, r.place_region) == (first[1] if metro else None, (big if metro else first)[1], first[5])


# ---------------------------------------------------------------- counters, aliases, pages
def test_pending_never_goes_below_zero(spark):
    rnd = random.Random(4)
    events = [(i, i % 2, f"f{rnd.randint(0, 9)}", rnd.choice([1, -1, -1]), 1_700_000_000 + i * 700) for i in range(400)]
    df = spark.createDataFrame(events, "event_id int, user_id int, flow_id string, delta int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.pending for r in ingest.pending(df).collect()}
    counter, released, want = {0: 0, 1: 0}, set(), {}
    for i, u, flow, d, _ in events:
        if d > 0:
            released.discard((u, flow))
            counter[u] += 1
        elif (u, flow) not in released:
            released.add((u, flow))
            counter[u] = max(0, counter[u] - 1)
        want[i] = counter[u]
    assert got == want


def test_one_instant_of_one_user_is_many_ranges(spark):
    """A user whose events all bear one time is split; so are others, and users without an id keep their rows."""
    rnd = random.Random(5)
    events = [(i, None if i % 50 == 0 else 2 if i % 50 == 1 else 1, rnd.choice([2, -1, -1]), 1_700_000_000) for i in range(3000)]
    df = spark.createDataFrame(events, "event_id int, user_id int, delta int, s long").withColumn("ts", F.timestamp_seconds("s"))
    sizes = [r["count"] for r in ingest.in_ranges(df, ["user_id", "ts", "event_id"], 8).where("user_id = 1").groupBy("_block").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1000
    got = {r.event_id: (r.total, r.low) for r in ingest.running_low(df, "user_id", "delta", blocks=8).collect()}
    total, low, want = {}, {}, {}
    for i, u, d, _ in events:
        total[u] = total.get(u, 0) + d
        low[u] = min(low.get(u, total[u]), total[u])
        want[i] = (total[u], low[u])
    assert got == want
    assert ingest.running_low(df.limit(0), "user_id", "delta").count() == 0


def test_alias_chains_of_ten(spark):
    alias = spark.createDataFrame([(1, i, i + 1, i) for i in range(10)], "user_id int, src int, dst int, ts int")
    faces = spark.createDataFrame([(1, 100, 0), (1, 101, 9), (1, 102, 50)], "user_id int, face_id int, person_id int")
    got = {r.face_id: r.person_id for r in people.resolve_alias(faces, alias).collect()}
    assert got == {100: 10, 101: 10, 102: 50}


def test_long_alias_chains_and_circles(spark):
    links = [(1, i, i + 1, i) for i in range(40)] + [(1, 90, 90, 1)]
    alias = spark.createDataFrame(links, "user_id int, src int, dst int, ts int")
    assert {(r.src, r.dst) for r in people.compress_aliases(alias).collect()} == {(i, 40) for i in range(40)}
    for n in (2, 3, 7):
        circle = spark.createDataFrame([(1, i, (i + 1) % n, i) for i in range(n)] + [(1, 50, 0, 1)], "user_id int, src int, dst int, ts int")
        with pytest.raises(ValueError, match="circle"):
            people.compress_aliases(circle)


def test_several_patches_of_a_key_give_one_row(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "file_id int, name string, size int")
    patches = spark.createDataFrame([(1, ["name"], "x", None, 1), (1, ["size"], None, 9, 2), (1, ["name"], None, None, 3), (3, ["name"], "z", None, 1)], "file_id int, fields array<string>, name string, size int, ts int")
    assert sorted(map(tuple, sinks.apply_patch(base, patches, ["file_id"], "ts").collect())) == [(1, None, 9), (2, "b", 6)]
    who = spark.createDataFrame([(1, 1, "Old", False)], "user_id int, person_id int, name string, hidden boolean")
    renames = spark.createDataFrame([(1, 1, True, " A ", None, 1), (1, 1, False, None, True, 2), (1, 1, True, "B", None, 3)], "user_id int, person_id int, has_name boolean, new_name string, new_hidden boolean, ts int")
    assert [tuple(r) for r in sinks.patch_people(who, renames).collect()] == [(1, 1, "B", True)]


def test_a_photo_with_very_many_faces(spark):
    rng = np.random.default_rng(3)
    v = unit(rng, 1501, 48)
    rows = [(1, 1, 1, f"f{i}", float(1500 - i), v[i].tolist()) for i in range(1500)] + [(1, 2, 2, "later", 1.0, v[700].tolist())]
    new = spark.createDataFrame(rows, "user_id int, file_id int, file_seq int, face_id string, score double, embedding array<double>")
    known = spark.createDataFrame([], "user_id int, file_id int, face_id string, person_id string, embedding array<double>")
    got = {r.face_id: r.person_id for r in fc.assign_faces(new, known, threshold=0.9).collect()}
    assert got["later"] == got["f700"] and len(set(got.values())) == 1500


def test_pages_cover_everything_once(spark, lib):
    mine = lib("files").filter("user_id = 1")
    seen, cursor = [], None
    while True:
        page = list_files(mine, limit=9, cursor=cursor).orderBy(F.desc("created_at"), F.desc("file_id")).collect()
        seen += [r.file_id for r in page]
        cursor = next((r.next_cursor for r in page if r.next_cursor), None)
        if cursor is None:
            break
    whole = mine.filter("status <> 'failed' and provider_file_id is not null").orderBy(F.desc("created_at"), F.desc("file_id"))
    assert seen == [r.file_id for r in whole.collect()]


@settings(max_examples=15, deadline=None)
@given(n=s.integers(0, 120), size=s.integers(1, 12), overlap=s.integers(0, 11))
def test_chunks_cover_every_word(spark, n, size, overlap):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.range(1).select(tx.split_words(F.lit(text)).alias("ws"))
    got = df.select(tx.chunk_words(F.col("ws"), size, overlap).alias("c")).head().c
    words, step, want = text.split(), max(1, size - overlap), []
    for start in range(0, len(words), step):
        want.append(" ".join(words[start : start + size]))
        if start + size >= len(words):
            break
    assert got == want


# ---------------------------------------------------------------- streams over several micro-batches
def flow_stream(spark, events, tmp_path):
    cuts = events.selectExpr("percentile_approx(event_id, array(0.3, 0.6)) as p").head().p
    for i, cond in enumerate([f"event_id <= {cuts[0]}", f"event_id > {cuts[0]} and event_id <= {cuts[1]}", f"event_id > {cuts[1]}"]):
        events.filter(cond).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))


def test_flows_over_many_batches(spark, lib, tmp_path):
    events = lib("stage_events").withColumn("stage", F.when(F.col("event_id") % 40 == 7, "cancel").otherwise(F.col("stage")))
    events = events.select("event_id", "user_id", "flow_id", "ts", "stage", "state", "props")
    log = str(tmp_path / "log")
    st.finalize_stream(flow_stream(spark, events, tmp_path), log, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(log).select("batch_id").distinct().count() == 3

    def rows(df):
        return sorted(map(str, df.collect()))

    want = rows(st.flow_outcomes(events))
    assert rows(st.current_outcomes(spark, log, stuck_us=st.FAR // 2)) == want and len(want) > 100
    # a replayed batch, and a folded log, say the same
    st.append_changes(st.flow_moments(spark.read.parquet(str(tmp_path / "in/part=0"))), 7, log)
    assert rows(st.current_outcomes(spark, log, stuck_us=st.FAR // 2)) == want
    st.fold_flows(spark, log, str(tmp_path / "log2"))
    assert rows(st.current_outcomes(spark, str(tmp_path / "log2"), stuck_us=st.FAR // 2)) == want
    # what is over may be left out of a fold, what is open stays
    st.fold_flows(spark, log, str(tmp_path / "log3"), keep_us=0)
    kept = {r.flow_id for r in spark.read.parquet(str(tmp_path / "log3")).collect()}
    over = {r.flow_id for r in st.flow_outcomes(events).where("outcome in ('ready', 'cancelled')").collect()}
    everything = {r.flow_id for r in events.select("flow_id").distinct().collect()}
    assert everything - over <= kept and len(kept & over) <= 1


STAGE_EVENTS = "event_id int, user_id long, flow_id string, stage string, state string, t string"


def stage_rows(spark, *rows):
    return spark.createDataFrame(list(rows), STAGE_EVENTS).withColumn("ts", F.col("t").cast("timestamp"))


def test_stuck_flows_are_settled(spark, tmp_path):
    df = stage_rows(spark, (1, 1, "f", "upload", "completed", "2024-01-01 00:00:00"), (2, 2, "g", "upload", "active", "2024-01-01 03:00:00"), (3, 3, "h", "upload", "completed", "2024-01-01 02:45:00"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    st.finalize_stream(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.flow_id, r.outcome) for r in st.current_outcomes(spark, str(tmp_path / "log")).collect()] == [("f", "settled")]


def test_outcomes_of_single_flows(spark):
    at = "2024-01-01 00:0{}:00".format
    flows = {
        "late sibling": [("embed", "failed", 1), ("upload", "completed", 2)],
        "faces may fail": [("upload", "completed", 1), ("faces", "failed", 2), ("embed", "completed", 3)],
        "failed, then cancelled": [("embed", "failed", 1), ("cancel", "active", 2), ("upload", "completed", 3)],
        "cancelled too late": [("upload", "completed", 1), ("docindex", "completed", 2), ("cancel", "active", 3)],
        "cancelled in time": [("upload", "completed", 1), ("cancel", "active", 2), ("docindex", "completed", 3)],
        "open": [("upload", "completed", 1), ("embed", "active", 2)],
    }
    rows = [(i, 1, f, stage, state, at(m)) for f, steps in flows.items() for i, (stage, state, m) in enumerate(steps)]
    got = {}
    for r in st.flow_outcomes(stage_rows(spark, *rows)).orderBy("at_us").collect():
        got.setdefault(r.flow_id, []).append(r.outcome)
    assert got == {
        "late sibling": ["failed", "stored"], "faces may fail": ["ready"], "failed, then cancelled": ["failed", "cancelled"],
        "cancelled too late": ["ready"], "cancelled in time": ["cancelled"],
    }
    assert st.flow_outcomes(stage_rows(spark, *rows).limit(0)).count() == 0


def test_cancelled_flows_leave_nothing(spark, tmp_path):
    """Rows, faces, vectors, passages and folders nothing else is in go, also after a replayed batch and from a compacted table."""
    files = spark.createDataFrame(
        [(1, 10, "a", 1, "Trips/Goa"), (1, 11, "b", 1, "Trips"), (1, 12, "c", 1, "Work"), (2, 20, "a", 1, "Trips/Goa")],
        "user_id long, file_id long, file_hash string, provider_id int, folder string",
    )
    faces = spark.createDataFrame(
        [(1, 1, 10, 7, 0.9), (1, 2, 11, 8, 0.8), (1, 3, 10, 8, 0.9), (2, 4, 20, 9, 0.5)], "user_id long, face_id long, file_id long, person_id long, score double"
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    persons = spark.createDataFrame([(1, 7, None, False), (1, 8, None, False), (2, 9, None, False)], "user_id long, person_id long, name string, hidden boolean")
    vectors = spark.createDataFrame([(1, "a"), (1, "rowless"), (1, "b"), (2, "a")], "user_id long, file_hash string")
    flows = spark.createDataFrame(
        [(1, "f1", "a", 1, "Trips/Goa"), (1, "f2", "rowless", 1, "New/One"), (1, "f3", "c", 1, "Work"), (1, "f4", "c", 1, "Work")],
        "user_id long, flow_id string, file_hash string, provider_id int, folder string",
    )
    events = stage_rows(
        spark,
        (1, 1, "f1", "upload", "completed", "2024-01-01 00:01:00"), (2, 1, "f1", "cancel", "active", "2024-01-01 00:02:00"), (3, 1, "f2", "cancel", "active", "2024-01-01 00:02:00"),
        (4, 1, "f3", "cancel", "active", "2024-01-01 00:02:00"), (5, 1, "f4", "upload", "completed", "2024-01-01 00:03:00"), (6, 1, "f4", "embed", "completed", "2024-01-01 00:04:00"),
    )
    lib = {"files": files, "faces": faces, "people": people.refresh_people(persons, faces), "image_index": vectors, "passages": vectors}
    log = str(tmp_path / "log")
    for replay in range(2):
        st.append_changes(st.flow_moments(events), 0, log)
        out, folders = st.undo_cancelled(lib, flows, st.current_outcomes(spark, log))
        assert {r.file_id for r in out["files"].collect()} == {11, 12, 20}  # c was cancelled once, but another flow made it ready
        assert {r.face_id for r in out["faces"].collect()} == {2, 4}
        assert {(r.person_id, r.face_count) for r in out["people"].collect()} == {(8, 1), (9, 1)}
        for name in ("image_index", "passages"):
            assert {tuple(r) for r in out[name].collect()} == {(1, "b"), (2, "a")}
        assert {r.path for r in folders.collect()} == ({"Trips/Goa", "New", "New/One"})
        for name, df in out.items():  # the compacted snapshot is undone again in the second round
            df.write.parquet(str(tmp_path / f"{replay}/{name}"))
        lib = {name: spark.read.parquet(str(tmp_path / f"{replay}/{name}")) for name in out}


def test_replayed_batch_changes_nothing(spark, lib, tmp_path):
    rows = lib("uploads").select("user_id", "file_hash", "upload_id", "ts")
    path = str(tmp_path / "log")
    for _ in range(2):
        st.append_changes(rows, 3, path)
    order = [F.desc("ts"), F.desc("upload_id")]
    now = st.current_rows(spark, path, ["user_id", "file_hash"], order)
    assert now.count() == rows.select("user_id", "file_hash").distinct().count()
    st.compact(spark, path, str(tmp_path / "log2"), ["user_id", "file_hash"], order)
    assert st.current_rows(spark, str(tmp_path / "log2"), ["user_id", "file_hash"], order).count() == now.count()


def test_streamed_faces_follow_earlier_batches(spark, tmp_path):
    rng = np.random.default_rng(8)
    vec = unit(rng, 60, 4).round(6).tolist()
    new = [(1, i // 3, i // 3, i, float(i % 3), vec[i]) for i in range(60)]
    schema = "user_id int, file_id int, file_seq int, face_id int, score double, embedding array<double>"
    for part in range(2):
        spark.createDataFrame(new[part * 30 : part * 30 + 30], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    none = spark.createDataFrame([], "user_id int, file_id int, face_id int, person_id string, embedding array<double>")
    out = str(tmp_path / "out")
    st.assign_faces_stream(stream, lambda: none, out, str(tmp_path / "ck"), 0.5).awaitTermination()
    got = {r.face_id: r.person_id for r in spark.read.parquet(out).collect()}
    assert got == sequential_faces(new, [], 0.5, 5)


def test_stream_view_is_a_stream(spark):
    from conftest import SF

    assert stream_view(spark, SF, "uploads").isStreaming


@pytest.mark.parametrize("key", ["stream_cancel_undo", "stream_dedup_uploads", "stream_faces", "stream_upsert_sink"])
def test_streams_read_tables_of_several_files(spark, tmp_path, key):
    """A table that is a folder of part files is streamed like one that is a single file."""
    import __spark_entry__
    from conftest import SF

    for name in ("documents", "embeddings", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = __spark_entry__.queries()[key]
    assert sorted(map(str, run(spark, str(tmp_path)).collect())) == sorted(map(str, run(spark, SF).collect()))


def test_paged_documents_keep_a_passage_each(spark):
    """A document without words is found by its title; cards count numbered pages and quote the first page that isn't empty."""
    docs = spark.createDataFrame(
        [(1, "a", "my_report-v2.pdf", " Quarterly Report "), (1, "b", "scan_001.pdf", None), (1, "c", "plain.docx", ""), (1, "d", "no_pages.pdf", None)],
        "user_id int, file_hash string, filename string, heading string",
    )
    pages = spark.createDataFrame(
        [(1, "a", 1, 1, ""), (1, "a", 2, 2, "# one two\nthree"), (1, "a", 3, 3, "four five six"), (1, "b", 1, 1, None), (1, "b", 2, 2, " \n"), (1, "c", 1, None, " ")],
        "user_id int, file_hash string, page_no int, page int, text string",
    )
    passages, cards = documents.index_paged_documents(docs, pages, size=2, overlap=1)
    got = {(r.file_hash, r.page, r.chunk): (r.text, r.embed_input) for r in passages.collect()}
    assert got == {
        ("a", 2, 0): ("# one", "Quarterly Report. # one"), ("a", 2, 1): ("one two", "Quarterly Report. one two"), ("a", 2, 2): ("two three", "Quarterly Report. two three"),
        ("a", 3, 3): ("four five", "Quarterly Report. four five"), ("a", 3, 4): ("five six", "Quarterly Report. five six"),
        ("b", 1, 0): ("scan 001", "scan 001. scan 001"), ("c", None, 0): ("plain", "plain. plain"), ("d", None, 0): ("no pages", "no pages. no pages"),
    }
    assert {r.file_hash: (r.title, r.page_count, r.excerpt) for r in cards.collect()} == {
        "a": ("Quarterly Report", 3, "one two three"), "b": ("scan 001", 2, ""), "c": ("plain", 1, ""), "d": ("no pages", 0, ""),
    }
