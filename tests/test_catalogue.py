"""Every query of the catalogue against its SQL in DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from anchorage.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    rows = _rows(columns, want.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == rows


def test_queries_find_something(duck):
    empty = {n for n, q in catalogue.SQL.items() if not duck.execute(q).fetchall()}
    assert empty <= {"dup_ids", "near_dup_ids", "range_conflict", "outcome_exists", "shape_rule", "scope_name_unique"}
