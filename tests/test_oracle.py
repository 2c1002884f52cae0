"""Every registered engine query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tarnflow import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x) + 0.0:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = q.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in q.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted([value(r[c]) for c in order] for r in rows)
    b = sorted([value(r[names.index(c)]) for c in order] for r in want)
    assert a == b


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql_works_as_a_view(name, duck):
    duck.execute(f'CREATE VIEW "v_{name}" AS {q.ORACLE_SQL[name]}')
    duck.execute(f'SELECT count(*) FROM "v_{name}"')


def test_lines_have_every_month_and_year(spark, sf_dir, duck):
    """The sums over all cells are those over the whole panel."""
    month = f"WITH {q._PANEL} SELECT count(*), sum(m), count(DISTINCT date) FROM (SELECT max(qtot) AS m, make_date(year, month, 15) AS date FROM panel GROUP BY BASIN_ID, year, month)"
    year = f"WITH {q._PANEL} SELECT count(*), sum(s), count(DISTINCT year) FROM (SELECT sum(qtot) AS s, year FROM panel GROUP BY BASIN_ID, year)"
    for name, sql, before, after in (("wide_basin_table", month, 3, 0), ("annual_wide_table", year, 2, 5)):
        rows = q.QUERIES[name](spark, sf_dir).collect()
        n = len(rows[0]["header"].split(",")) - before - after
        assert all(r["header"] == rows[0]["header"] and len(r["line"].split(",")) == before + n + after for r in rows)
        cells = [float(c) for r in rows for c in r["line"].split(",")[before : before + n] if c]
        assert (len(cells), sum(cells), n) == duck.execute(sql).fetchone()
