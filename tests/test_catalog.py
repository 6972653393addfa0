"""Every query of the catalog beside its SQL in DuckDB."""

import os

import duckdb
import pytest

from gridloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def shown(rows):
    def one(v):
        return str(round(v, 7) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    rows = [tuple(r) for r in found.select(*[f"`{c}`" for c in names]).toLocalIterator()]
    assert shown(rows) == shown(want.fetchall())


def test_pct_change_rounds_as_its_sql(spark, duck, tmp_path):
    # (57.63 - 6.4) / 6.4 is just under 8.0046875; 0 / 0 is NaN, not null
    values = [6.4, 57.63, 0.0, 0.0, 1.28, 2.25, -0.0000005, 3.0, float("nan"), 1.0, None, 2.0, 1e-300, 1e300]
    spark.createDataFrame([(i, i // 100, v) for i, v in enumerate(values)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = duck.execute(catalog.SQL["pct_change"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    found = catalog.QUERIES["pct_change"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, v and v + 0.0)) for i, v in want)


@pytest.mark.parametrize("rows", [0, 1, 6_000_000])
def test_sample_replace_of_small_and_large_tables(spark, duck, tmp_path, rows):
    spark.range(rows).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    want = duck.execute(catalog.SQL["sample_replace"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["sample_replace"](spark, str(tmp_path)).collect()] == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(catalog.SQL) <= set(__spark_entry__.oracle_sql())
