"""Every registered query with a SQL twin gives the same rows; the others give some."""

import pytest
from conftest import SF
from oracle import compare, connect

import registry

registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_matches_sql(spark, con, key):
    problems = [p for p in compare(spark, con, SF, registry.QUERIES[key], registry.ORACLES[key]) if p != "no rows"]
    assert not problems, problems


def test_every_query_has_a_twin_or_a_reason():
    sequential = {
        "face_cluster", "stream_faces", "search_pipeline", "join_fuzzy_name", "join_model_extract",
    }
    assert set(registry.QUERIES) - set(registry.ORACLES) <= sequential
