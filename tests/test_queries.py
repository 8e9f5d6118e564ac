"""Every graph query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from pangraph_spark.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return [columns[k] for k in order], sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = duck.execute(SQL[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([c[0] for c in found.description], found.fetchall())


ODD = """SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-01 00:00:00', 'a'), (1, TIMESTAMP '2024-01-01 00:00:00', 'a'), (1, TIMESTAMP '2024-01-01 00:01:00', 'b'),
    (2, TIMESTAMP '2024-01-01 05:35:00', 'a'), (3, NULL, 'a'), (4, TIMESTAMP '2024-01-01 00:00:00', NULL), (NULL, TIMESTAMP '2024-01-01 00:00:30', 'b'),
    (5, TIMESTAMP '1969-12-31 18:27:00', 'a'), (6, TIMESTAMP '1969-12-31 23:58:30', 'a'), (7, TIMESTAMP '1969-12-31 18:26:00', 'a'), (8, TIMESTAMP '1969-12-31 18:25:30', 'a')) t(event_id, ts, event_type)"""


@pytest.mark.parametrize("name", ["pileup_counts", "variant_read_overlap"])
def test_odd_events_match_sql(spark, tmp_path, name):
    """Repeated and missing ids, times and types, and times before 1970, whose windows may be empty."""
    con = duckdb.connect()
    con.execute(f"COPY ({ODD}) TO '{tmp_path}/events.parquet'")
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{tmp_path if f.stem == 'events' else FOLDER}/{f.name}'")
    df = QUERIES[name](spark, str(tmp_path))
    found = con.execute(SQL[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([c[0] for c in found.description], found.fetchall())


def test_entry_point_without_optional_parts():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
