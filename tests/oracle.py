"""Rows of a DataFrame against rows of SQL that DuckDB runs over the same files."""

import os

import duckdb
import pandas as pd

TABLES = "documents embeddings pages benchmark labels conversations events lineitem orders customer supplier part nation region".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _cell(x):
    if x is None or x is pd.NA or x != x:
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    try:
        return f"{float(x):.9g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(_cell(x) for x in r) for r in pdf.itertuples(index=False))


def same(df, con, sql):
    got, want = rows(df.toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
