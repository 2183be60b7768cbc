"""Secret scanning over the lines of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import SECRETS, is_lock_file, redact


def scan_secrets(docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """(doc_id, line, column, pattern, severity, matched): the first match per line and
    pattern, redacted; lock files are skipped. Narrow: lines never leave their task."""
    if path is not None:
        docs = docs.where(~F.coalesce(is_lock_file(F.col(path)), F.lit(False)))
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")).alias("i", "line_text"))
    found = F.filter(
        F.array(*(F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), F.regexp_extract("line_text", regex, 0).alias("m"), F.regexp_instr("line_text", F.lit(regex)).alias("at")) for name, regex, severity in SECRETS)),
        lambda x: x["m"] != "",
    )
    flat = lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line"), F.explode(found).alias("f"))
    return flat.select("doc_id", "line", F.col("f.at").cast("bigint").alias("column"), "f.pattern", "f.severity", redact(F.col("f.m")).alias("matched"))
