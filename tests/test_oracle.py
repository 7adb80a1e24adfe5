"""Every registered query, run over whole tables, against its SQL in DuckDB."""

import math

import duckdb
import pytest
from scrivenry.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = rows_of(df.columns, df.collect())
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        wanted = rows_of(columns, want.fetchall())
        assert len(found) == len(wanted)
        for a, b in zip(found, wanted, strict=True):
            assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in a + b) else str(a) == str(b) or near(a, b)
    else:
        assert found


def near(a, b):
    return all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True))
