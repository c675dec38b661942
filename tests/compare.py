"""Compare a query's rows with its SQL's, whatever their order."""

import glob
import os

import duckdb
import pandas as pd


def connected(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(spark, query, sql, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), connected(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) and rows(mine) == rows(theirs)
