"""Row sets of two engines as comparable text."""

import duckdb
import numpy as np
import pandas as pd

from slicelake.fixtures import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(float(v)) if isinstance(v, (int, float, np.number)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(zip(*[df[c].map(_text) for c in columns], strict=True)) if len(df) else []
