"""Compare registered queries with their SQL on another engine."""

import math

import duckdb

from flowspark.sources.views import TABLES

KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def differences(spark, folder: str, build, sql: str, connection=None) -> str | None:
    """None when both sides agree, else a short description."""
    connection = connection or connect(folder)
    df = build(spark, folder)
    names = sorted(df.columns)
    got_types = {c: KINDS[t] for c, t in df.dtypes}
    answer = connection.execute(sql)
    wanted_types = {d[0]: str(d[1]).upper() for d in answer.description}
    wanted_names = [d[0] for d in answer.description]
    if sorted(wanted_names) != names:
        return f"columns {names} != {sorted(wanted_names)}"
    rows = answer.fetchall()
    types = {r[0]: r[1] for r in connection.execute(f"describe {sql}").fetchall()}
    if types != got_types:
        return f"types {got_types} != {types}"
    order = [wanted_names.index(n) for n in names]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in rows)
    got = sorted(tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    if len(got) != len(want):
        return f"{len(got)} rows, wanted {len(want)}"
    off = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(off)} of {len(got)} rows differ, first {off[0]}" if off else None
