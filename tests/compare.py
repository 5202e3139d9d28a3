"""Compare a Spark result with a DuckDB result as multisets of rows."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_duckdb(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    return sorted(names), rows


def differences(df, con, sql):
    names, left = rows_of_spark(df)
    other, right = rows_of_duckdb(con, sql)
    if names != other:
        return f"columns {names} != {other}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"{sum(left.values())} vs {sum(right.values())} rows; spark only {list(only_left)[:3]}; "
            f"sql only {list(only_right)[:3]}"
        )
    return None
