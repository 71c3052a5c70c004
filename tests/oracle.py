"""Compares a query's rows with those of its SQL in DuckDB, as the driver does."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(frame, columns):
    # A column of integers with nulls is of floats on one side, of nullable integers on the other.
    frame = frame.astype({c: "float64" for c in columns if str(frame[c].dtype) == "Int64"})
    return sorted(tuple(str(v) for v in row) for row in frame[columns].itertuples(index=False))


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got, columns) == rows(want, columns)
