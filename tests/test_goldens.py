"""Known answers of text, date, geography, ranking and scaling rules."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from mediashelf.functions import dates, geo
from mediashelf.functions import text as tx
from mediashelf.functions import vectors as vc
from mediashelf.operators import documents, geocode, ingest, ranking, understand
from mediashelf.operators.vector_search import refine_kind
from mediashelf.plans.search import search
from mediashelf.sources.folders import read_folder
from mediashelf.sources.uploads import load_gazetteer, read_text_docs, read_tree

TODAY = dt.date(2026, 10, 3)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("v")).head().v


# ---------------------------------------------------------------- text
def test_filename_words(spark):
    assert one(spark, tx.filename_words(F.col("n")), n="IMG_4412_goaBeachSunset.jpg") == ["goa", "beach", "sunset"]


def test_folder_path(spark):
    assert one(spark, tx.folder_path(F.col("n")), n="../Trips//Goa: 2024/") == "Trips/Goa_ 2024"


def test_clean_name_composes_unicode(spark):
    assert one(spark, tx.clean_name(F.col("n")), n="Café?.txt") == "Café_.txt"
    assert one(spark, tx.clean_name(F.col("n")), n=" ... ") == ""


def test_chunks_overlap_and_respect_pages(spark):
    words = " ".join(f"w{i}" for i in range(700))
    pages = spark.createDataFrame([(1, "h", 1, 1, words), (1, "h", 2, 2, "short page"), (1, "h", 3, 3, "  ")], "user_id int, file_hash string, page_no int, page int, text string")
    rows = documents.chunk_pages(pages).orderBy("chunk").collect()
    assert [(r.page, r.chunk) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 3)]
    assert rows[0].text.split()[-50:] == rows[1].text.split()[:50]
    assert rows[3].text == "short page"


def test_document_without_text_is_found_by_title(spark):
    docs = spark.createDataFrame([(1, "h", "my_scan-1.txt", " \n ")], "user_id int, file_hash string, filename string, text string")
    row = documents.index_documents(docs).head()
    assert (row.title, row.chunk, row.text, row.embed_input) == ("my scan 1", 0, "my scan 1", "my scan 1. my scan 1")


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(100)) + " Normalization rules " + " ".join(f"v{i}" for i in range(100))
    got = one(spark, tx.snippet(F.col("t"), F.col("q")), t=text, q="normalization")
    assert got.startswith("… w87") and got.endswith(" …") and len(got.split()) == 42


def test_coverage(spark):
    assert one(spark, tx.term_coverage(F.col("q"), F.col("t")), q="quantum physics lecture", t="Lecture 10") == pytest.approx(1 / 3)
    assert one(spark, tx.term_coverage(F.col("q"), F.col("t")), q="the and", t="anything") == 1.0


def test_format_bytes(spark):
    rows = spark.createDataFrame([(0,), (500,), (2048,), (5 * 1024**2,), (int(1.5 * 1024**3),), (None,)], "b long")
    assert [r.v for r in rows.select(tx.format_bytes(F.col("b")).alias("v")).collect()] == ["0 B", "500 B", "2 KB", "5 MB", "1.5 GB", "0 B"]


def test_format_bytes_rounds_like_c(spark):
    """Halves to even, and a decimal by the exact value of the double, not by its shortest digits."""
    kb, gb, tb = 1024.0, 1024.0**3, 1024.0**4
    sizes = [18.5 * kb, 19.5 * kb, 0.5, 1.5, 2.5, 1023.5 * kb, 1.25 * gb, 1.75 * gb, 1.15 * gb, 1.35 * gb, 8.45 * gb, 99.95 * gb, 1023.96 * gb, 1023.25 * tb, 5e6 * tb, 0.3]
    sizes += [(i + 0.05) * gb for i in range(1, 300)] + [(i / 20) * tb for i in range(20, 600)] + [(i + 0.5) * kb for i in range(1, 300)]

    def c_like(b):
        step = min(4, math.floor(math.log(b) / math.log(1024.0)))
        return f"{b / 1024.0 ** step:.{1 if step >= 3 else 0}f} " + ("B", "KB", "MB", "GB", "TB")[step]

    rows = spark.createDataFrame([(b,) for b in sizes if b >= 1], "b double").select("b", tx.format_bytes(F.col("b")).alias("v")).collect()
    assert {r.b: r.v for r in rows} == {b: c_like(b) for b in sizes if b >= 1}


# ---------------------------------------------------------------- dates
RANGES = {
    "last summer": ("2026-06-01", "2026-08-31"),
    "last winter": ("2025-12-01", "2026-02-28"),
    "yesterday": ("2026-10-02", "2026-10-02"),
    "last month": ("2026-09-01", "2026-09-30"),
    "two years ago": ("2024-01-01", "2024-12-31"),
    "christmas eve 2023": ("2023-12-24", "2023-12-24"),
    "new year's eve 2022": ("2021-12-31", "2022-01-01"),
    "last week": ("2026-09-21", "2026-09-27"),
    "this winter": ("2025-12-01", "2026-02-28"),
    "march 2024": ("2024-03-01", "2024-03-31"),
    "past 3 weeks": ("2026-09-12", "2026-10-03"),
    "christmas eve": (None, None),
    "dogs that may be sleeping": (None, None),
}


@pytest.mark.parametrize("text", RANGES)
def test_date_phrases(spark, text):
    got = one(spark, dates.date_phrase(F.col("q"), F.lit(TODAY)), q=f" {text} ")
    want = tuple(v and dt.date.fromisoformat(v) for v in RANGES[text])
    assert (got.date_from, got.date_to) == want if got else want == (None, None)


def test_bare_month_means_any_year(spark):
    assert one(spark, dates.date_phrase(F.col("q"), F.lit(TODAY)), q=" in may ").month == 5


def test_small_hours_are_night(spark):
    words = one(spark, dates.date_words(F.lit("2024-12-25 03:10:00").cast("timestamp")))
    assert words == ["2024", "december", "dec", "wednesday", "winter", "2024-12", "christmas", "day", "holidays", "night"]


def test_strip_dates(spark):
    got = one(spark, dates.strip_dates(F.col("q"), F.lit(TODAY)), q=" dogs in march 2024 and cats from last week ")
    assert got.split() == ["dogs", "and", "cats"]


# ---------------------------------------------------------------- understanding
def test_understand(spark):
    q = spark.createDataFrame([(1, 7, "Rahul at the beach in Goa last summer", TODAY), (2, 8, "Rahul in Goa", TODAY), (3, 7, "photos of New York and York", TODAY)], "query_id int, user_id int, text string, today date")
    people = spark.createDataFrame([(7, "Rahul"), (7, "Maya")], "user_id int, name string")
    places = spark.createDataFrame([(7, "Goa"), (7, "York"), (7, "New York")], "user_id int, place string")
    rows = {r.query_id: r for r in understand.understand_queries(q, people, places).collect()}
    assert (rows[1].people, rows[1].places, rows[1].visual_query) == (["Rahul"], ["Goa"], "beach")
    assert (rows[1].date_from, rows[1].date_to) == (dt.date(2026, 6, 1), dt.date(2026, 8, 31))
    assert (rows[2].people, rows[2].places, rows[2].visual_query) == ([], [], "rahul in goa")
    assert (rows[3].places, rows[3].visual_query) == (["New York", "York"], None)


def test_model_answers_are_checked(spark):
    q = spark.createDataFrame([(1, 7, "pics of rahoul with receipts yesterday", TODAY)], "query_id int, user_id int, text string, today date")
    people = spark.createDataFrame([(7, "Rahul"), (7, "Maya")], "user_id int, name string")
    places = spark.createDataFrame([(7, "Goa")], "user_id int, place string")
    said = spark.createDataFrame([(1, "Rahul photos yesterday", ["rahul", "Maya", "Bob"], ["goa"], ["photo", "hologram"])], "query_id int, visual_query string, people array<string>, places array<string>, kinds array<string>")
    rules = understand.understand_queries(q, people, places)
    r = understand.merge_extracted(rules, said, people, places).head()
    assert (r.people, r.places, r.kinds, r.visual_query, r.source) == (["Rahul"], [], ["receipt", "photo"], None, "llm")
    assert r.date_from == dt.date(2026, 10, 2)


# ---------------------------------------------------------------- ranking
def images(spark, rows):
    return spark.createDataFrame(rows, "query_id int, file_hash string, prob double, margin double")


def words(spark, rows):
    return spark.createDataFrame(rows, "query_id int, file_hash string, bm25 double")


def test_image_gate(spark):
    vec = images(spark, [(1, "a", 0.3, 0.05), (1, "b", 0.25, 0.02), (1, "c", 0.2, 0.004), (1, "d", 0.1, -0.03), (2, "blue", 0.84, 0.075), (2, "red", 0.0004, 0.02)])
    rows = ranking.fuse_images(vec, words(spark, []), 10).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.file_hash) for r in rows] == [(1, "a"), (1, "b"), (2, "blue")]


def test_image_labels(spark):
    vec = images(spark, [(1, "w", 0.9, 0.07), (1, "x", 0.8, 0.035), (1, "y", 0.7, 0.02)])
    got = {r.file_hash: r.match for r in ranking.fuse_images(vec, words(spark, [(1, "z", 3.0)]), 10).collect()}
    assert got == {"w": "strong", "x": "good", "y": "possible", "z": "metadata"}


def passages(spark, rows, score):
    return spark.createDataFrame(rows, f"query_id int, file_hash string, page int, chunk int, text string, {score} double")


def test_passage_fusion(spark):
    vec = passages(spark, [(1, "notes", 7, 6, "normal forms", 0.88), (1, "notes", 2, 1, "intro", 0.83), (1, "report", None, 0, "report", 0.83), (1, "recipe", None, 0, "cake", 0.74)], "cos")
    kw = passages(spark, [(1, "glossary", None, 0, "normalization explained", 9.0)], "bm25")
    q = spark.createDataFrame([(1, "normalization")], "query_id int, keywords string")
    rows = ranking.fuse_docs(vec, kw, q, 10).orderBy("position").collect()
    assert rows[0].file_hash == "notes" and rows[0].page == 7 and rows[0].match == "strong"
    assert {r.file_hash: r.match for r in rows}["glossary"] == "keyword"
    assert {r.file_hash for r in rows} == {"notes", "report", "glossary"}


def test_keyword_only_passage_needs_the_words(spark):
    kw = passages(spark, [(i, "db", None, 0, "Lecture 10: NoSQL databases", 5.0) for i in (1, 2)], "bm25")
    q = spark.createDataFrame([(1, "quantum physics lecture"), (2, "nosql lecture")], "query_id int, keywords string")
    rows = ranking.fuse_docs(passages(spark, [], "cos"), kw, q, 10).collect()
    assert [(r.query_id, r.match) for r in rows] == [(2, "keyword")]


def test_mmr_spreads_duplicates(spark):
    hits = spark.createDataFrame([(1, "dup1", 0.9, 1), (1, "dup2", 0.9, 2), (1, "other", 0.85, 3), (1, "weak", 1.0, 4), (1, "novec", 0.1, 5)], "query_id int, file_hash string, score double, position int")
    vec = spark.createDataFrame([(1, "dup1", [1.0, 0.0, 0.0]), (1, "dup2", [0.9999, 0.01, 0.0]), (1, "other", [0.8, 0.6, 0.0]), (1, "weak", [0.0, 0.0, 1.0])], "query_id int, file_hash string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0])], "query_id int, embedding array<float>")
    rows = ranking.rerank_mmr(hits, vec, q, scale=10.0, bias=-5.0).orderBy("position").collect()
    order = [r.file_hash for r in rows]
    assert order[0] in ("dup1", "dup2") and order[1] == "other" and order[-2:] == ["weak", "novec"]


def test_external_scores(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1, "good"), (1, "b", 0.8, 2, "good"), (1, "c", 0.7, 3, "good")], "query_id int, file_hash string, score double, position int, match string")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.1)], "query_id int, file_hash string, rating double")
    rows = ranking.rerank_with_scores(hits, scores).orderBy("position").collect()
    assert [(r.file_hash, r.match) for r in rows] == [("c", "strong"), ("b", "possible"), ("a", "good")]


def test_refine_kind(spark):
    def kind(camera, receipt, name="x.jpg"):
        probs = F.create_map(F.lit("receipt"), F.lit(receipt))
        return one(spark, refine_kind(F.lit("meme"), probs, F.lit(camera), F.lit(None), F.lit(name)))

    assert [kind("Pixel", 0.05), kind("Pixel", 0.6), kind(None, 0.6), kind(None, 0.0, "Screenshot_1.png")] == ["photo", "receipt", "meme", "screenshot"]


def test_probability(spark):
    assert one(spark, vc.match_prob(F.lit(0.1), 100.0, -100.0)) == 0.0
    assert one(spark, vc.match_prob(F.lit(0.25), 100.0)) == pytest.approx(0.5)
    assert one(spark, F.array_max(vc.normalize(F.array(F.lit(0.0), F.lit(0.0))))) == 0.0


@pytest.mark.parametrize("case", [(0, 20, 1, 8, 1), (61, 20, 1, 8, 4), (10000, 20, 1, 8, 8), (5, 0, 1, 8, 5)])
def test_replicas(spark, case):
    assert one(spark, ingest.desired_replicas(*[F.lit(v) for v in case[:4]])) == case[4]


# ---------------------------------------------------------------- geography and files
@pytest.fixture
def gazetteer(spark, tmp_path):
    def row(**at):
        cells = [""] * 19
        for k, v in at.items():
            cells[int(k[1:])] = v
        return "\t".join(cells)

    (tmp_path / "cities15000.txt").write_text(
        "\n".join([
            row(c0="1", c1="Mumbai", c4="19.07283", c5="72.88261", c8="IN", c10="16", c14="12691836"),
            row(c0="2", c1="Panaji", c4="15.49574", c5="73.82624", c8="IN", c10="33", c14="114405"),
            row(c0="3", c1="Dharavi", c4="19.0380", c5="72.8538", c8="IN", c10="16", c14="500000"),
        ]) + "\n"
    )
    (tmp_path / "admin1CodesASCII.txt").write_text("IN.33\tGoa\tGoa\t1\nIN.16\tMaharashtra\tMaharashtra\t2\n")
    (tmp_path / "countryInfo.txt").write_text("# comment\nIN\tIND\t356\tIN\tIndia\n")
    return load_gazetteer(spark, str(tmp_path))


def test_reverse_geocode(spark, gazetteer):
    pts = spark.createDataFrame([(1, 15.55, 73.75), (2, 25.0, 75.0), (3, 19.04, 72.85), (4, 200.0, 0.0), (5, -80.0, -120.0)], "id int, lat double, lon double")
    rows = {r.id: r for r in geocode.reverse_geocode(pts, gazetteer).collect()}
    assert rows[1].place_name == "Panaji, Goa, India"
    assert (rows[2].place_city, rows[2].place_country) == (None, "India")
    assert (rows[3].place_area, rows[3].place_city) == ("Dharavi", "Mumbai")
    assert rows[4].place_name is None and rows[5].place_name == "India"


def test_bad_gps_gives_null(spark):
    assert one(spark, geo.dms_to_decimal(F.lit("x"), F.lit("1"), F.lit("2"), F.lit("N"))) is None
    assert one(spark, geo.dms_to_decimal(F.lit("10"), F.lit("30"), F.lit("0"), F.lit("S"))) == -10.5


def test_read_files(spark, tmp_path):
    (tmp_path / "Trips" / "Goa").mkdir(parents=True)
    (tmp_path / "Trips" / "Goa" / "a.md").write_bytes(b"# Hi\xff there")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "c.exe").write_text("x")
    tree = {(r.folder, r.name): r.size for r in read_tree(spark, str(tmp_path)).collect()}
    assert tree == {("Trips/Goa", "a.md"): 11, ("", "b.txt"): 1}
    docs = {r.filename: r.text for r in read_text_docs(spark, str(tmp_path)).collect()}
    assert docs == {"a.md": "# Hi� there", "b.txt": "x"}


def test_folders_of_any_name_and_size(spark, tmp_path):
    """Names with an underscore, blanks and umlauts; a folder dealt to many tasks gives each file once, with its hash."""
    (tmp_path / "_album" / "Ä b").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    content = {("", "_a.jpg"): b"\xff\xd8", ("_album", "c.JPG"): b"", ("_album/Ä b", "d 1%.pdf"): b"%PDF" * 9}
    content |= {("_album", f"n{i}.txt"): bytes([i]) * i for i in range(50)}
    for (folder, name), data in content.items():
        (tmp_path / folder / name).write_bytes(data)
    (tmp_path / "_album" / "no.exe").write_bytes(b"x")
    expected = sorted((f, n, len(d), hashlib.sha256(d).hexdigest()) for (f, n), d in content.items())
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert sorted(tuple(r) for r in read_tree(spark, root).collect()) == expected
    assert sorted(tuple(r) for r in read_tree(spark, str(tmp_path), hash_content=False).collect()) == [r[:3] for r in expected]
    parts = read_folder(spark, str(tmp_path), ["name", "content", "file_hash"], r"(?i)\.(jpg|pdf|txt)$", partition_bytes=600_000)
    rows = parts.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.name, bytes(r.content), r.file_hash) for r in rows) == sorted((n, d, hashlib.sha256(d).hexdigest()) for (_, n), d in content.items())
    assert len({r.task for r in rows}) > 10
    assert read_tree(spark, str(tmp_path / "empty")).collect() == []


# ---------------------------------------------------------------- the whole search
def test_search_end_to_end(spark):
    file_schema = (
        "user_id int, file_id int, file_hash string, name string, media_type string, status string, provider_file_id string, kind string, taken_at timestamp, created_at timestamp, "
        "place_name string, place_area string, place_city string, place_region string, place_country string"
    )

    def f(user, fid, h, media="image", place=None, taken=None):
        return (user, fid, h, f"{h}.jpg", media, "ready", "p", "photo", taken, dt.datetime(2026, 1, 1), place, None, place, None, None)

    goa = dt.datetime(2026, 7, 1)
    files = spark.createDataFrame([f(1, 1, "beach", place="Goa", taken=goa), f(1, 2, "dog"), f(1, 3, "notes", "document"), f(2, 4, "beach2"), f(1, 5, "old", place="Goa", taken=goa)], file_schema)
    faces = spark.createDataFrame([(1, 1, 1, 10)], "user_id int, face_id int, file_id int, person_id int")
    people = spark.createDataFrame([(1, 10, "Rahul", False)], "user_id int, person_id int, name string, hidden boolean")
    idx = "user_id int, embed_model string, file_hash string, embedding array<float>, tags array<string>, search_text string"
    index = spark.createDataFrame([(1, "m", "beach", [1.0, 0.0], ["beach"], "photo beach"), (1, "m", "dog", [0.0, 1.0], ["dog"], "photo dog"), (2, "m", "beach2", [1.0, 0.0], ["beach"], "x"), (1, "m", "old", [0.6, 0.8], [], "x")], idx)
    psg = spark.createDataFrame([(1, "notes", "Notes", 2, 0, "all about normalization of tables", [0.0, 1.0])], "user_id int, file_hash string, title string, page int, chunk int, text string, embedding array<float>")
    q = spark.createDataFrame(
        [(i, u, t, TODAY, "m", v, [0.1, 0.1], d) for i, u, t, v, d in [
            (1, 1, "Rahul at the beach in Goa last summer", [1.0, 0.0], [1.0, 0.0]),
            (2, 1, "photos from Goa", [1.0, 0.0], [1.0, 0.0]),
            (3, 2, "beach", [1.0, 0.0], [1.0, 0.0]),
            (4, 1, "normalization", [0.7, 0.7], [0.0, 1.0]),
            (5, 1, "Rahul yesterday", [1.0, 0.0], [1.0, 0.0]),
        ]],
        "query_id int, user_id int, text string, today date, embed_model string, embedding array<float>, baseline array<float>, doc_embedding array<float>",
    )
    lib = {"files": files, "faces": faces, "people": people, "image_index": index, "passages": psg}
    rows = search(q, lib, k=5, scale=50.0, bias=-20.0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault((r.query_id, r.section), []).append(r.file_hash)
    assert got[(1, "image")] == ["beach"]  # people, place, dates and the visual part
    assert got[(2, "image")] == ["beach", "old"]  # filters only: newest first
    assert got[(3, "image")] == ["beach2"]  # the other user's files never show
    assert got[(4, "document")] == ["notes"]
    assert not [k for k in got if k[0] == 5]  # nothing passes the filter: empty, not unfiltered
    note = next(r for r in rows if r.query_id == 4 and r.section == "document")
    assert note.page == 2 and "normalization" in note.snippet


