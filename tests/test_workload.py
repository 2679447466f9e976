"""A few queries against their SQL on the smallest tables; ``tools/check.py`` runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
NAMES = (
    "symbol_extract", "bad_line_stats", "dictionary_extend", "position_to_trace", "shared_supermax",
    "near_supermax_repeats", "repeat_occurrences", "tandem_fused", "tandem_arrays", "substring_lookup",
    "classification_metrics",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def cells(rows):
    return sorted("|".join(repr(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(theirs) == columns
    want = [tuple(r[theirs.index(c)] for c in columns) for r in cur.fetchall()]
    assert cells(tuple(r) for r in df.select(*columns).collect()) == cells(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
