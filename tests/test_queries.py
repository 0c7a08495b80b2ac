"""Registered queries against DuckDB on the smallest tables.

A selection that touches every module runs by default; GRANTLAKE_ALL=1 runs all.
"""

import math
import os

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("GRANTLAKE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SELECTION = [
    "export_headers", "document_items", "archive_normalised", "item_fact", "tag_grants", "tag_column_masks", "tag_set_items",
    "identity_table", "conflict_members", "duplicate_grants", "nested_paths", "gap_summary", "readiness", "effective_grants",
    "secured_customers", "merged_masks", "restricted_columns", "filter_columns", "expression_issues", "else_branches",
    "script_notices", "latest_events", "log_comparison",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def normal(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("GRANTLAKE_ALL") else SELECTION)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert normal(got.select([f"`{c}`" for c in columns]).collect()) == normal(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
