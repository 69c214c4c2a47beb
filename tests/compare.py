"""Comparing a Spark query with its SQL: names, types, rows, values."""

import duckdb
import pandas as pd

VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def sql_engine(folder):
    con = duckdb.connect()
    for view in VIEWS:
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{folder}/{view}.parquet'")
    return con


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    columns = {}
    for c in frame.columns:
        s = frame[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.astype("datetime64[us]")
        columns[c] = [None if pd.isna(v) else v for v in s.tolist()]
    plain = pd.DataFrame(columns, dtype=object)
    return sorted(plain.itertuples(index=False, name=None), key=repr)


def differences(spark_frame, con, sql):
    """What differs between the two results, as text; empty if nothing does."""
    mine, theirs = spark_frame.toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    kinds = [(c, mine[c].dtype.kind, theirs[c].dtype.kind) for c in mine.columns]
    odd = [k for k in kinds if k[1] != k[2] and {k[1], k[2]} - {"O", "T"}]
    if odd:
        return f"types {odd}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    a, b = _plain(mine), _plain(theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
