"""Every registered query of the alignment operators against its SQL."""

from __future__ import annotations

import pytest
from compare import DATA, rows, sql_rows

from tandemtext.queries import ORACLES, QUERIES

#: Queries that SQL can't express; other tests hold them against written-out answers.
NO_SQL = {"resolved_round", "score_after_repair", "corrected_conflicts", "task_variants", "corrected_by_length", "corrected_by_similarity", "robust_fit"}


def test_all_have_sql_but_the_known():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    got = QUERIES[name](spark, str(DATA))
    names, expected = sql_rows(ORACLES[name])
    assert sorted(got.columns) == names
    assert expected and rows(got) == expected


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name", ["corrected_by_length", "corrected_by_similarity"])
def test_walks_and_vectors_are_made_once(spark, name):
    # what Python makes is read by several joins; each would make it anew
    assert "MapInPandas" not in QUERIES[name](spark, str(DATA))._jdf.queryExecution().analyzed().toString()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
