"""Every registered query against its SQL in DuckDB: rows, columns and values."""

import duckdb
import pytest
from pyspark.sql.types import LongType

import __spark_entry__ as entry
from rasterloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, name, query, sql, folder):
    rows = query(spark, folder)
    # pandas makes floats of whole numbers with nulls, of Spark's and DuckDB's at different times
    found = rows.toPandas().astype({f.name: "Int64" for f in rows.schema if f.dataType == LongType()})
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    told = db.sql(sql)
    want = told.df().astype({c: "Int64" for c, kind in zip(told.columns, told.types, strict=True) if kind == "BIGINT"})
    columns = sorted(found.columns)
    assert columns == sorted(want.columns), name
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (found, want))
    assert len(a) == len(b) and len(a), name
    for c in columns:
        kind = {str(a[c].dtype).replace("Int", "int"), str(b[c].dtype).replace("Int", "int")}
        assert len({k.split("[")[0] for k in kind}) == 1, (name, c, kind)
        x, y = a[c].astype(object).where(a[c].notna(), None), b[c].astype(object).where(b[c].notna(), None)
        assert all(p == q or (isinstance(p, float) and abs(p - q) < 1e-9 * max(1, abs(q))) for p, q in zip(x, y, strict=True)), (name, c)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    same(spark, name, catalogue.QUERIES[name], catalogue.SQL[name], small)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
