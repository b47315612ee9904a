"""Run a registered query and its SQL on the same tables and compare the results."""

from pathlib import Path

import duckdb
import pyarrow as pa


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_integer(t):
        return f"int{t.bit_width}"
    return "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)


def _canonical(table: pa.Table) -> tuple[dict, list]:
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = {n: _kind(table.schema.field(n).type) for n in names}
    rows = zip(*(table.column(n).to_pylist() for n in names))
    return kinds, sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def differences(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    got_kinds, got = _canonical(spark_df.toArrow())
    want_kinds, want = _canonical(con.sql(sql).to_arrow_table())
    if got_kinds != want_kinds:
        return f"schema {set(got_kinds.items()) ^ set(want_kinds.items())}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{list(got_kinds)}: {g}, expected {w}"
    return None
