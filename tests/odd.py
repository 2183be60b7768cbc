"""Tables for edge cases: empty ones, and ones with NULLs in every column and clashing column names."""

import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
CLASHING = ("n", "id", "a", "b", "k", "pos", "tbl", "record_id", "value", "field", "hash", "tokens", "zone", "utc_us", "_salt", "h", "start", "stop", "bucket", "size", "basket", "rep", "linked", "period")


def odd_tables(folder, kind: str) -> str:
    """Write the smallest tables without rows, or with rows added that are NULL in one column or in
    all, repeated rows, and more columns; returns the folder."""
    os.makedirs(folder, exist_ok=True)
    for f in glob.glob(SF + "/*.parquet"):
        t = pq.read_table(f)
        t = t.cast(pa.schema([pa.field(x.name, x.type) for x in t.schema]))
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            parts = [t, pa.table([pa.nulls(3, x.type) for x in t.schema], schema=t.schema)]
            for i, x in enumerate(t.schema):
                parts.append(t.slice(0, 2).set_column(i, x, pa.nulls(min(2, t.num_rows), x.type)))
            t = pa.concat_tables(parts)
            for name in CLASHING:
                if name not in t.column_names:
                    t = t.append_column(name, pa.array(["x"] * t.num_rows))
        pq.write_table(t, os.path.join(folder, os.path.basename(f)))
    return str(folder)


def tables_in(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con
