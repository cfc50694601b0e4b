"""Every query beside its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quakespark.plans import cells, files, geodesy, lines, models, patches, queries, sources  # noqa: F401 (they register their queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = queries.REGISTRY[name](spark, sf)
    rel = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(b, float) and math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-4)), (g, w)


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.REGISTRY[name](spark, sf).count() > 0
