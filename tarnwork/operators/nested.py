"""Deeply nested records to flat tables: path-value-ordinal triples, grouped and pivoted.

Each JSON payload is parsed once and walked once; every object of a list that stands under
one of the repeated names becomes a row identified by (record, path, pos), and its scalar
fields leave as triples of that row. Triples are grouped by the path of their repeated
ancestor and pivoted into one table per path, whose rows name their parent row.

Results for edge cases: NULL, empty, cut-off or otherwise invalid payloads give no rows; a
NULL element keeps its place and gives no row; a lone object counts as a list of one; JSON
inside a string is read as JSON; an empty object is a row without fields; a list inside a
list adds a place to pos; repeated records give one set of rows; an empty table gives an
empty result. Columns of the input other than the record key and payload are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names under which lists of objects repeat.
REPEATED = ("files", "results", "reviews", "comments", "goals", "steps", "artifacts", "params", "generics", "evidence")

TRIPLES = "rec bigint, path string, pos string, parent_path string, parent_pos string, field string, value string"


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


#: Whether a string may hold JSON that is a list, an object or a string, after any blanks.
_opens = re.compile(r'\s*["\[{]').match


def _read(text: str):
    """The JSON value of a text, or None."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None


def triples(payload: str | None, repeated: frozenset[str]) -> list[tuple]:
    """(path, pos, parent_path, parent_pos, field, value) of one payload; field None marks the row itself.

    A field's name holds the names and places between the row's object and the scalar.
    """
    if not payload:
        return []
    out: list[tuple] = []
    # a stack instead of recursion, with: value, path, pos, parent path, parent pos, field, and
    # whether the value hangs directly on a repeated name ("open") or is an item of its list
    stack = [(_read(payload), "", "", "", "", "", "")]
    while stack:
        value, path, pos, up_path, up_pos, field, state = stack.pop()
        kind = type(value)
        if kind is str and _opens(value):
            inner = _read(value)
            if isinstance(inner, (dict, list)) or (isinstance(inner, str) and _opens(inner)):
                stack.append((inner, path, pos, up_path, up_pos, field, state))
                continue
        if kind is dict:
            if state:
                if state == "open":
                    pos = f"{pos}.0" if pos else "0"
                out.append((path, pos, up_path, up_pos, None, None))
                up_path, up_pos, field = path, pos, ""
            for k, v in value.items():
                if v is None:
                    continue
                if k in repeated:
                    stack.append((v, f"{path}.{k}" if path else k, pos, up_path, up_pos, "", "open"))
                else:
                    stack.append((v, path, pos, up_path, up_pos, f"{field}.{k}" if field else k, ""))
        elif kind is list:
            for i, v in enumerate(value):
                if v is not None:
                    stack.append((v, path, f"{pos}.{i}" if pos else str(i), up_path, up_pos, f"{field}[{i}]", "item" if state else ""))
        elif up_path and field and value is not None and not state:
            out.append((up_path, up_pos, None, None, field, value if kind is str else json.dumps(value)))
    return out


_ARROW = pa.schema([("rec", pa.int64()), ("path", pa.string()), ("pos", pa.string()), ("parent_path", pa.string()), ("parent_pos", pa.string()), ("field", pa.string()), ("value", pa.string())])


def to_triples(df: DataFrame, key: str, payload: str, repeated: tuple[str, ...] = REPEATED) -> DataFrame:
    """Path-value-ordinal triples of every record, parsed where the record lies; no shuffle."""
    names = frozenset(repeated)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            keys, path, pos, up_path, up_pos, field, value = columns
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in triples(text, names):
                    keys.append(k)
                    path.append(row[0])
                    pos.append(row[1])
                    up_path.append(row[2])
                    up_pos.append(row[3])
                    field.append(row[4])
                    value.append(row[5])
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)
                    for c in columns:
                        c.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    rows = df.select(F.col(key).cast("bigint").alias("rec"), F.col(payload).alias("payload")).where(F.col("rec").isNotNull() & F.col("payload").isNotNull())
    return rows.mapInArrow(parse, TRIPLES)


def pivot_rows(spread: DataFrame) -> DataFrame:
    """One row per object: (rec, path, pos, parent_path, parent_pos, fields map<string,string>).

    Grouped by the row's own key, so a group holds one object; aggregates a query doesn't
    use are pruned from the plan.
    """
    entry = F.when(F.col("field").isNotNull(), F.struct("field", "value"))
    grouped = spread.groupBy("rec", "path", "pos").agg(F.max("parent_path").alias("parent_path"), F.max("parent_pos").alias("parent_pos"), F.collect_set(entry).alias("entries"))
    unique = F.aggregate(F.array_sort("entries"), F.expr("cast(array() as array<struct<field:string,value:string>>)"), lambda got, e: F.when((F.size(got) > 0) & (F.element_at(got, -1)["field"] == e["field"]), got).otherwise(F.concat(got, F.array(e))))
    return grouped.select("rec", "path", "pos", "parent_path", "parent_pos", F.map_from_entries(unique).alias("fields"))


def one_table(rows: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The flat table of one path: record, pos, parent link and the named fields as columns."""
    return rows.where(F.col("path") == path).select("rec", "pos", "parent_path", "parent_pos", *(F.col("fields")[c].alias(c) for c in columns))
