"""Every registered query against its SQL, and that the others run."""

from __future__ import annotations

import oracle
import pytest

from corpusloom.plans import knowledge, relational, scalars, views

DATA = "/root/testdata/sf0.001"
assert knowledge and relational and scalars


@pytest.fixture(scope="module")
def con():  # noqa: ANN201
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(views.SQL))
def test_same_as_sql(spark, con, name):  # noqa: ANN001
    assert oracle.compare(views.QUERIES[name](spark, DATA), con, views.SQL[name]) == ""


def test_queries_without_sql_have_brute_force():
    """Their results are tested in test_knowledge."""
    assert set(views.QUERIES) - set(views.SQL) == {"chunk_units", "chunk_transcripts", "chunk_notes", "chunk_tasks", "chunk_code", "recall", "search_knowledge", "match_knowledge", "remember", "semantic_seeds_indexed"}


def test_entry(spark):  # noqa: ANN001
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(views.QUERIES) <= set(e.queries())
