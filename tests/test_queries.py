"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest
from conftest import SF

from arbora.plans import catalog, matching, models, networks  # noqa: F401  they register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return str(v.date() if isinstance(v, dt.datetime) and v == dt.datetime.combine(v.date(), dt.time()) else v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLE_SQL[name])
    columns, want = [d[0] for d in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want)


def test_sessions_that_had_ended(spark, tmp_path):
    """A row in time reaches a session that ended in the first run; exact gaps; ids that are negative or null."""
    base, hours = dt.datetime(2024, 1, 1), [
        (1, 1, 100), (14, 1, 110),  # the watermark comes to 52, then to 62
        (2, 2, 48), (7, 2, 50),
        (3, 3, 48), (4, 3, 51),
        (8, 4, 48), (21, 4, 47), (28, 4, 49.5),
        (9, 5, 48), (35, 5, 50), (10, 5, 52.5), (11, 5, 55), (12, 5, 57), (13, 5, 59.5),
        (-3, 6, 50), (None, None, 50), (15, None, 47), (16, 7, None),
    ]
    made = spark.createDataFrame([(i, u, None if h is None else base + dt.timedelta(hours=h)) for i, u, h in hours], "event_id long, user_id long, ts timestamp_ntz")
    made.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = con.execute(catalog.ORACLE_SQL["sessions_with_late_rows"])
    columns, want = [d[0] for d in got.description], got.fetchall()
    df = catalog.QUERIES["sessions_with_late_rows"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(columns, want)
    assert (2, base + dt.timedelta(hours=48), 2) in want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
