"""Registered queries: SQL twins, whole tables, and the pipeline stage by stage."""

import itertools
from collections import Counter

import pytest
from conftest import SF
from oracle import compare, connect

import corpus_pipeline
from mediashelf.llm import decontaminate, mixing, queries, sharding, toxicity

TABLE = {2: "embeddings", 3: "conversations", 9: "pages"}


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_matches_sql(spark, key):
    assert not compare(spark, connect(SF), SF, queries.QUERIES[key], queries.ORACLES[key])


@pytest.mark.parametrize("key", ["op4_remove_repeats", "op5_shard", "op7_simhash_groups", "op8_language", "op9_url_filter", "op10_toxicity", "op11_periodic_runs", "op12_substring_dedup"])
def test_whole_tables(spark, key):
    table = TABLE.get(int(key[2:].split("_")[0]), "documents")
    assert queries.QUERIES[key](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def shingles(text, words=5):
    """The set of a text's word shingles; all words are one if there are fewer."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on its own input, held against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        was, now = [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]
        assert name == "sharding" or after.columns == docs.columns
        kept = {r["doc_id"] for r in now}
        if name == "toxicity":
            scores = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet")).scores([r["text"].encode() for r in was])
            assert kept == {r["doc_id"] for r, s in zip(was, scores) if s < 0.5} and len(kept) < len(was)
        elif name == "near_duplicates":
            sets = [shingles(r["text"]) for r in was]
            root = list(range(len(was)))
            for i, j in itertools.combinations(sorted(range(len(was)), key=lambda i: was[i]["doc_id"]), 2):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    old, new = root[j], root[i]
                    root = [new if r == old else r for r in root]
            first = {}
            for r, g in zip(was, root):
                first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
            assert kept == set(first.values()) and len(kept) < len(was)
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {r["doc_id"] for r in was if any(t in r["text"] for t in items)}
            assert held and kept == {r["doc_id"] for r in was} - held
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert Counter(r["doc_id"] for r in now) == Counter({k: n for k, n in copies.items() if n})
        else:
            assert Counter(r["doc_id"] for r in now) == Counter(r["doc_id"] for r in was)
            loads = Counter()
            for r in now:
                loads[r["shard"]] += r["size"]
            assert len({(r["shard"], r["slot"]) for r in now}) == len(now) and set(loads) <= set(range(40))
        before = after
    assert decontaminate.IN_ORDER and sharding.BUNDLES


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, no rows, and columns named like results, which keep their values."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, "b " * 40), (5, "b " * 40), (5, "b " * 40), (6, "é 漢字   x " * 9), (7, long), (8, long + " end"), (None, None)]
    names = ("Score", "predicted", "size", "copy", "copies", "target", "key", "n", "prefix", "component_id", "label", "body", "item_id")
    data = [(i, t, None if k % 3 else f"s{k % 2}", None, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} string" for n in names))
    whole = Counter(data)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name == "sharding":
            assert {"shard", "slot"} <= set(got.columns) and Counter(map(tuple, got.select("doc_id", "text", "key").collect())) == Counter((r[0], r[1], r[10]) for r in data)
            continue
        assert got.columns == docs.columns
        now = Counter(map(tuple, got.collect()))
        if name == "near_duplicates":
            assert {r for r in whole if r not in now} == {r for r in data if r[0] in (2, 3, 8)} and sum(now.values()) == len(data) - 3
        elif name == "mixing":
            taken = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs.select("doc_id", "text", "source")).where("doc_id is not null and doc_id <> 5").collect()})
            assert Counter({r[0]: n for r, n in now.items() if r[0] not in (None, 5)}) == +taken and set(now) <= set(whole)
        else:
            assert now == whole
