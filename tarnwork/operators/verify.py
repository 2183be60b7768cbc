"""Verification of declared expectations: a guarded SQL gate and a small pipe language.

A claim is (belief_id, label, type, text, expect); text is SQL, `command --pattern "x" |
count(distinct field)`, or `derive-moments | summary.field`. Each claim gives one number,
which is compared with the expectation: pass, contested, or error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.text import expectation_met
from tarnwork.operators.assay import like_pattern, moments_summary

# Statements that a query must not contain.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH", "DETACH", "PRAGMA", "REPLACE", "VACUUM", "REINDEX")


@dataclass(frozen=True)
class Command:
    table: str
    searched: tuple[str, ...]
    fields: tuple[str, ...]


# Commands, the table and columns each searches, and the fields it may count.
COMMANDS = {
    "callers": Command("call_graph", ("callee",), ("file", "caller", "callee", "call_type")),
    "callees": Command("call_graph", ("caller",), ("file", "caller", "callee", "call_type")),
    "functions": Command("function_facts", ("name", "file"), ("file", "name", "is_public", "is_async", "return_type")),
    "imports": Command("import_facts", ("file",), ("import_path", "import_kind")),
    "importers": Command("import_facts", ("import_path",), ("file",)),
}
# Fields of a history's summary.
SUMMARY_FIELDS = ("total_commits", "genesis", "big_bang", "major", "breaking", "migration", "rewrite")

_BLOCK = re.compile(r"^```verify([^\n]*)\n(.*?)^```", re.S | re.M)
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')
_PIPE = re.compile(r'^\s*(\w+)\s+--pattern\s+"([^"]*)"\s*(?:\|\s*(.+?)\s*)?$')


class Refused(ValueError):
    pass


def check_sql(sql: str) -> str:
    """The query, if it only reads; Refused otherwise."""
    lines = [x.strip() for x in sql.splitlines()]
    words = " ".join(x for x in lines if not x.startswith("--")).strip().upper()
    if not words:
        raise Refused("empty query")
    if not words.startswith(("SELECT", "WITH")):
        raise Refused("query must start with SELECT or WITH")
    if ";" in words.rstrip(";"):
        raise Refused("one statement only")
    for k in FORBIDDEN:
        if re.search(rf"(^|[^A-Z0-9_]){k}($|[^A-Z0-9_])", words):
            raise Refused(f"query contains forbidden keyword: {k}")
    return sql.strip().rstrip(";")


def parse_blocks(markdown: str) -> list[dict[str, str]]:
    """Claims of the fenced blocks in the section `## Verification`."""
    section = re.search(r"(?ms)^## Verification\s*$(.*?)(?=^## |\Z)", markdown)
    found = []
    for m in _BLOCK.finditer(section[1] if section else ""):
        a = dict(_ATTRIBUTE.findall(m[1]))
        found.append({"type": a.get("type", "sql"), "label": a.get("label", ""), "expect": a.get("expect", ""), "text": m[2].strip()})
    return found


def assay_plan(text: str, tables: dict[str, DataFrame]) -> DataFrame:
    m = _PIPE.match(text)
    if not m or m[1] not in COMMANDS:
        raise Refused(f"unknown command: {text.strip()[:40]}")
    c = COMMANDS[m[1]]
    if c.table not in tables:
        raise Refused(f"table {c.table} is not available")
    found = F.lit(False)
    for x in c.searched:
        found = found | F.coalesce(F.col(x).ilike(like_pattern(m[2])), F.lit(False))
    rows, step = tables[c.table].where(found), m[3] or "count"
    if step == "count":
        return rows.agg(F.count(F.lit(1)).alias("value"))
    d = re.fullmatch(r"count\(distinct (\w+)\)", step)
    if not d or d[1] not in c.fields:
        raise Refused(f"unknown step: {step}")
    return rows.agg(F.count_distinct(d[1]).alias("value"))


def temporal_plan(text: str, tables: dict[str, DataFrame]) -> DataFrame:
    m = re.fullmatch(r"\s*derive-moments\s*\|\s*summary\.(\w+)\s*", text)
    if not m or m[1] not in SUMMARY_FIELDS:
        raise Refused(f"unknown temporal query: {text.strip()[:40]}")
    return moments_summary(tables["commits"], tables["commit_files"]).select(F.col(m[1]).alias("value"))


def sql_plan(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The first column of the first row as a number; tables are seen as views with flags as 0 and 1."""
    sql = check_sql(text)
    for name, df in tables.items():
        df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"}).createOrReplaceTempView(name)
    out = spark.sql(sql)
    return out.select(F.col(f"`{out.columns[0]}`").try_cast("double").alias("value")).limit(1)


def verify(spark: SparkSession, claims: list[dict[str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """(belief_id, label, type, value, status, error), one row a claim; all good claims run as one plan."""
    parts, errors = [], []
    for c in claims:
        try:
            make = {"sql": lambda t: sql_plan(spark, t, tables), "assay": lambda t: assay_plan(t, tables), "temporal": lambda t: temporal_plan(t, tables)}.get(c["type"])
            if make is None:
                raise Refused(f"unknown query type: {c['type']}")
            value = make(c["text"])
            tagged = value.select(F.lit(c["belief_id"]).alias("belief_id"), F.lit(c["label"]).alias("label"), F.lit(c["type"]).alias("type"), F.col("value").cast("double").alias("value"), F.lit(c["expect"]).alias("expect"))
            tagged.schema  # analysis errors show here
            parts.append(tagged)
        except (Refused, PySparkException) as e:
            errors.append((c["belief_id"], c["label"], c["type"], None, "error", str(e).split("\n")[0]))
    failed = spark.createDataFrame(errors, "belief_id string, label string, type string, value double, status string, error string")
    if not parts:
        return failed
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    met = expectation_met(F.col("value"), F.col("expect"))
    status = F.when(met.isNull(), "error").when(met, "pass").otherwise("contested")
    error = F.when(F.col("value").isNull(), "no number").when(met.isNull(), "bad expectation")
    return rows.select("belief_id", "label", "type", "value", status.alias("status"), error.alias("error")).unionByName(failed)


def verification_counts(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.groupBy("belief_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "pass").alias("passed"), F.count_if(s == "contested").alias("contested"), F.count_if(s == "error").alias("errored"))
