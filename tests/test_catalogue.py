"""Every registered query against its DuckDB text, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lociform.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem embeddings".split()


def rows(d: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    made = [tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False)]
    return sorted(made, key=lambda r: [(isinstance(v, str), round(v, 3) + 0.0 if isinstance(v, float) else v) for v in r])


def same(a: tuple, b: tuple) -> bool:
    return all(abs(x - y) < 2e-3 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, db, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    wrong = [(x, y) for x, y in zip(rows(got), rows(want), strict=True) if not same(x, y)]
    assert not wrong, wrong[:2]
