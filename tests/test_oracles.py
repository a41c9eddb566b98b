"""Every query with a SQL twin, compared row by row with DuckDB."""

import pytest

import __spark_entry__ as entry
from scales import MEDIUM, SMALL
from tools.check_oracles import compare, database

# three sources per tier, and so the quantile in the SQL, exist from this scale on
NEEDS_MEDIUM = {"confidence_interval"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    folder = MEDIUM if name in NEEDS_MEDIUM else SMALL
    ours = entry.queries()[name](spark, folder).toPandas()
    theirs = database(folder).execute(entry.oracle_sql()[name]).df()
    assert compare(ours, theirs) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
    assert abs(sum(r["weight"] for r in rows) - 1.0) < 1e-5
    by_tier = {r["quality"]: r["trust"] for r in rows}
    assert by_tier["high"] > by_tier["medium"] > by_tier["low"] > by_tier["compromised"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
