"""Comparison of Spark and SQL results."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def rows(frame) -> list[tuple]:
    """Rows as comparable values, columns and rows in order."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("~" if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


def database(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con
