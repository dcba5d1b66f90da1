"""Hold a query's rows against DuckDB's for the same tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def text(v):
        return str(int(v)) if isinstance(v, bool) else repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in values)


def compare(df, sql: str, folder: str) -> None:
    result = connection(folder).execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())
