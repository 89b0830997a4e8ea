"""Run a registered query in Spark and its SQL in DuckDB and compare the two as multisets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        return float(f"{value:.9g}") + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got = df.collect()
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        only_a, only_b = list((a - b).items()), list((b - a).items())
        return f"{sum((a - b).values())} rows differ; cols {sorted(df.columns)}; spark {only_a[:3]} sql {only_b[:3]}"
    if not got:
        return "both sides are empty"
    spark_types = dict(df.dtypes)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for d in res.description:
        want_kind, have = str(d[1]), kinds.get(spark_types[d[0]], spark_types[d[0]])
        if want_kind.upper() != have and os.environ.get("STRICT_TYPES"):
            return f"type of {d[0]}: {have} != {want_kind}"
    return None
