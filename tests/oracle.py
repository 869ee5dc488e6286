"""Hold a query's rows against DuckDB SQL on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value) is True):
        return None
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(value, float) and value.is_integer() else value  # integers with nulls


def same_rows(spark, con, query, sql: str) -> None:
    got = query(spark, str(DATA)).toPandas()
    want = con.execute(sql).fetchdf()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = [sorted(str([_plain(v) for v in r]) for r in df[names].itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]
