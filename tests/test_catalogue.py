"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from tideline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda x: round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else None if x is None else str(x)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, db, name):
    got, want = rows(catalogue.queries()[name](spark, FOLDER).toArrow()), rows(db.sql(catalogue.SQL[name]).fetch_arrow_table())
    assert got == want


def test_classification_has_rows(spark):
    got = catalogue.queries()["e11_classification"](spark, FOLDER).toPandas()
    assert len(got) and {"unavailable", "insufficient_evidence"} <= set(got.classification) and (got.reasons != "").any()
