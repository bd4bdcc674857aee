"""Run driver queries next to their SQL and compare rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0 if value != 0 else 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if type(value).__name__ == "date" else value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_result(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql: str):
    relation = con.sql(sql)
    return sorted(relation.columns), rows_of(list(relation.columns), relation.fetchall())


def types(df, relation):
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
        "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
    }
    found = {c: names.get(t, t) for c, t in df.dtypes}
    wanted = dict(zip(relation.columns, map(str, relation.types)))
    return {c: (found.get(c), wanted.get(c)) for c in wanted if found.get(c) != wanted.get(c)}
