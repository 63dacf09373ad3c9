"""Runs a query and its SQL twin over the same small tables and compares the results."""

import os

import duckdb
import pandas as pd

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(FOLDER)):
        path = os.path.join(FOLDER, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    out = pd.DataFrame(index=frame.index)
    for name in sorted(frame.columns):
        c = frame[name]
        if pd.api.types.is_float_dtype(c):
            c = c.round(6) + 0.0
        elif pd.api.types.is_datetime64_any_dtype(c):
            c = c.dt.strftime("%Y-%m-%d")
        out[name] = c.astype(object).where(c.notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def differences(spark, query, sql) -> str:
    """Empty if equal."""
    got, want = plain(query(spark, FOLDER).toPandas()), plain(connect().execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} and {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    apart = got.ne(want).any(axis=1)
    return f"{got[apart].head(3).to_dict('records')} and {want[apart].head(3).to_dict('records')}" if apart.any() else ""
