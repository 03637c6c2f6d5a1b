"""Every registered query: on empty tables, on nulls with clashing columns, and against its SQL on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from quarry.plans import catalog

DATA = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v.replace(tzinfo=None)) if getattr(v, "tzinfo", None) else str(v)


def compare(query, sql, spark, folder):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    df = catalog.queries()[name](spark, empty_dir)
    assert len(df.columns) > 0
    df.collect()


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_nulls(spark, null_dir, name):
    catalog.queries()[name](spark, null_dir).collect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    compare(catalog.queries()[name], catalog.oracle_sql()[name], spark, DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_year_text_list_runs_its_searches_once(spark, tmp_path, monkeypatch):
    plain, runs = catalog._two_lists, str(tmp_path / "runs")

    def told(batches):
        with open(runs, "a") as f:
            f.write("x\n")
        yield from batches

    monkeypatch.setattr(catalog, "_two_lists", lambda asked, chunks: [x.coalesce(1).mapInArrow(told, x.schema) for x in plain(asked, chunks)])
    catalog.queries()["year_text_list"](spark, DATA).collect()
    with open(runs) as f:
        assert len(f.readlines()) == 2
