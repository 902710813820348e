"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from skein.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df[sorted(df.columns)]
    show = lambda x: "NULL" if x is None or x is pd.NaT or x is pd.NA or x != x else repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(show, row)) for row in df.astype(object).values.tolist())


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, db, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if sql := registry.oracle_sql().get(name):
        want = db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.parametrize("name", ["search_lexical", "search_two_phase", "ingested_sessions", "hit_rows"])
def test_generated_code_compiles(spark, sf_dir, name):
    """No fallback to interpreted code where a generated class grows too large."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert registry.queries()[name](spark, sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
