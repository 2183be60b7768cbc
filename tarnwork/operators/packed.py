"""Several values packed in one field: dialect choice by minimum description length.

A field such as ``bug; "wontfix, duplicate"`` can be read under many dialects (a set of
delimiters, a wrapper and a quoting rule). Each distinct field text is parsed under every
dialect; the values of all parses give a distributed code book (-log2 of a value's share,
with a character model behind it for values that are rare); a parse costs its dialect plus
the codes of its values, and the cheapest parse is kept. The code book is then estimated
once more from the kept parses only, and the choice is repeated. Lengths of codes are sums
of logarithms, so neither long values nor long texts are cut or flattened.

Results for edge cases: NULL, empty and blank texts, and texts that hold nothing but
``-``, ``null``, ``none`` or ``n/a``, give no rows; repeated values keep their places;
repeated rows of the input give one result row; an empty input gives an empty result;
ties between parses go to the dialect that comes first in DIALECTS.
"""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.shaping import join_counted, written

STRONG = ",;|，、•\n\t"
#: name -> delimiters, from plain to mixed; "and" stands for the word between two numbers.
DIALECTS: list[tuple[str, tuple[str, ...]]] = [
    ("whole", ()),
    *((f"one {d!r}", (d,)) for d in STRONG),
    ("slash", ("/",)),
    ("blank", (" ",)),
    ("strong", tuple(STRONG)),
    ("strong slash", (*STRONG, "/")),
    ("strong blank", (*STRONG, " ")),
    ("any", (*STRONG, "/", " ")),
    ("any and", (*STRONG, "/", " ", "and")),
]
NOTHING = {"", "-", "null", "none", "n/a"}
CLOSERS = {"[": "]", "{": "}"}

#: What a value may hold when it stands without quotes, beyond letters and digits.
ALPHABETS = {"labels": " /:&+-'.", "words": "-", "numbers": ""}

#: A character outside the alphabet must cost more than the escapes of two values never seen before.
_CHAR_BITS, _ALIEN_BITS, _DIALECT_BITS, _SMOOTH = 6.5, 80.0, 1.0, 4.0
#: Distinct texts that a parsing task should have at least; parsing is CPU-bound on few bytes.
TEXTS_A_TASK = 4_000


def _blank(c: str) -> bool:
    return c.isspace() or c in "﻿​"


def _unquote(text: str, at: int) -> tuple[str, int] | None:
    """The value of the quoted stretch that opens at `at`, and the place after its close."""
    q, i, n, out = text[at], at + 1, len(text), []
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            d = text[i + 1]
            if d == "u" and i + 6 <= n:
                try:
                    out.append(chr(int(text[i + 2 : i + 6], 16)))
                    i += 6
                    continue
                except ValueError:
                    pass
            if d in "\"'\\/":
                out.append(d)
                i += 2
                continue
        if c == q:
            if i + 1 < n and text[i + 1] == q:
                out.append(q)
                i += 2
                continue
            if q == "'" and i > at + 1 and text[i - 1].isalnum() and i + 1 < n and text[i + 1].isalnum():
                out.append(c)  # an apostrophe within a word
                i += 1
                continue
            return "".join(out), i + 1
        out.append(c)
        i += 1
    return None


def _pieces(text: str, delimiters: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(value, quoted) between delimiters; a quote opens only where a value begins."""
    singles = {d for d in delimiters if len(d) == 1}
    blank_cuts, and_cuts = " " in singles, "and" in delimiters
    found: list[tuple[str, bool]] = []
    i, n = 0, len(text)
    while i <= n:
        while i < n and text[i] not in singles and (_blank(text[i]) or (text[i] in "-#" and (text[i] == "#" or i + 1 == n or _blank(text[i + 1])))):
            i += 1
        if i < n and text[i] in "\"'":
            got = _unquote(text, i)
            if got:
                value, j = got
                k = j
                while k < n and text[k] not in singles and _blank(text[k]):
                    k += 1
                if k == n or text[k] in singles or (blank_cuts and k > j):
                    found.append((value, True))
                    i = k + 1 if k < n and text[k] in singles else k + (k == n)
                    if k == n:
                        break
                    continue
        j = i
        while j < n and text[j] not in singles:
            j += 1
        found.append((text[i:j], False))
        i = j + 1
    if and_cuts:
        found = [p for p in found if p[1] or p[0].strip().lower() != "and"]
    return found


def _clean(value: str, quoted: bool, kind: str) -> str:
    value = value.strip(" \t\r\n ﻿　")
    if not quoted:
        while value[:1] == "#" or value[:2] in ("- ", "-\t"):
            value = value[1:].lstrip()
    if kind == "numbers":
        low = value.lower()
        value = value[3:] if low.startswith("gh-") else value
        value = value.lstrip("#")
    return "" if value.lower() in NOTHING else value


def _structured(text: str) -> list[tuple[str, bool]] | None:
    """A JSON array or the printed form of a list, as its own items; otherwise None."""
    if text[:1] != "[" or text[-1:] != "]":
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            items = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
        if isinstance(items, list) and all(isinstance(x, (str, int, float, type(None))) for x in items):
            return [("" if x is None else str(x), isinstance(x, str)) for x in items]
    return None


def model_bits(length: int) -> float:
    """Bits of a value under the character model. They enter as logarithms, so no length underflows."""
    return _CHAR_BITS * length + 2


def parses(text: str, kind: str) -> list[tuple[str, float, list[str]]]:
    """Every distinct parse that can be the cheapest: dialect, bits that don't depend on the code book, values."""
    text = text.strip(" \t\r\n ﻿　")
    inner, wrapped = text, False
    if len(text) > 1 and CLOSERS.get(text[0]) == text[-1]:
        inner, wrapped = text[1:-1], True
    readings: list[tuple[str, float, list[tuple[str, bool]]]] = []
    items = _structured(text) if wrapped else None
    if items is not None:
        readings.append(("list", 0.0, items))
    for rank, (name, delimiters) in enumerate(DIALECTS):
        if name == "any and" and kind != "numbers":
            continue
        if wrapped:
            readings.append(("in " + name, rank * _DIALECT_BITS, _pieces(inner, delimiters)))
        readings.append((name, rank * _DIALECT_BITS, _pieces(text, delimiters)))
    allowed, found, seen = ALPHABETS[kind], [], set()
    for name, bits, pieces in readings:
        values = []
        for value, quoted in pieces:
            value = _clean(value, quoted, kind)
            if value:
                values.append(value)
                if kind == "numbers":
                    bits += _ALIEN_BITS * sum(not c.isdigit() for c in value)
                elif not quoted:
                    bits += _ALIEN_BITS * sum(not (c.isalnum() or c in allowed) for c in value)
        if (key := tuple(values)) not in seen:
            seen.add(key)
            found.append((name, bits, values))
    # no code is longer than this for up to 2**40 values, so parses beyond the least such sum can't win
    most = min(bits + sum(model_bits(len(v)) + 40 for v in values) for _, bits, values in found)
    return [p for p in found if p[1] <= most]


_CANDIDATES = "field string, text string, n bigint, cands array<struct<dialect:string,bits:double,vals:array<string>>>"
_ARROW = pa.schema([("field", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("cands", pa.list_(pa.struct([("dialect", pa.string()), ("bits", pa.float64()), ("vals", pa.list_(pa.string()))])))])


def _parser(kinds: dict[str, str]):
    def rare(bits: float, values: list[str]) -> float:
        # a code is log2(total + smooth) less than this for a value that was counted once
        return bits + sum(model_bits(len(v)) + 1.0 - math.log2(_SMOOTH) for v in values)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cands = [[{"dialect": d, "bits": rare(b, v), "vals": v} for d, b, v in parses(t, kinds[f])] for f, t in zip(fields, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cands, _ARROW.field("cands").type)], schema=_ARROW)

    return parse


def _choose(cands: DataFrame, book: DataFrame, totals: DataFrame) -> DataFrame:
    """cands with c, its cheapest parse; of equals the first.

    book: (field, value, n) of values counted more than once; totals: (field, total), of all
    counts. The code of a value is -log2 of its share, (n - 1 + s * 2**-model) / (total + s).
    Only what counted values save against values counted once is joined, and only for texts
    with several parses; the others are decided.
    """
    several = cands.where(F.size("cands") > 1).select("id", "field", F.posexplode("cands").alias("k", "c"))
    values = several.select("id", "field", "k", F.explode("c.vals").alias("value"))
    model = _CHAR_BITS * F.length("value") + 2
    saving = model + F.log2((F.col("n") - 1) / _SMOOTH + F.pow(F.lit(2.0), -model))
    saved = join_counted(values, book, ["field", "value"], "n").groupBy("id", "k").agg(F.sum(saving).alias("saved"))
    saved = saved.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "saved"))).alias("saved"))
    # one total a field: as many rows as there are fields
    met = cands.join(F.broadcast(totals), "field").join(saved, "id", "left")
    bits = lambda c, k: F.round(c["bits"] + F.size(c["vals"]) * F.log2(F.col("total") + _SMOOTH) - F.coalesce(F.col("saved")[k], F.lit(0.0)), 6)
    best = F.array_min(F.transform("cands", lambda c, k: F.struct(bits(c, k).alias("bits"), k.alias("k"))))
    return met.select("field", "text", "n", F.get("cands", best["k"]).alias("c"))


def split_packed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Split every text of df(field, record_id, text) by its cheapest dialect.

    kinds: field -> labels, words or numbers, the alphabet of its unquoted values.
    Returns (field, record_id, dialect, pos, value), the values of every distinct text of a
    record; pos counts from 1.
    """
    spark = df.sparkSession
    rows = df.select("field", "record_id", "text").where(F.col("text").isNotNull() & F.col("record_id").isNotNull()).distinct()
    texts = written(rows.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n")))
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    texts = texts.repartition(min(most, 1 + texts.count() // TEXTS_A_TASK))
    cands = written(texts.mapInArrow(_parser(kinds), _CANDIDATES).withColumn("id", F.monotonically_increasing_id()))
    # at first a value counts once for every text in whose parses it occurs
    possible = cands.select("field", F.explode(F.array_distinct(F.flatten(F.transform("cands", lambda c: c["vals"])))).alias("value"))
    counts = written(possible.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_values"))
    first = _choose(cands, counts.where("n > 1"), totals.drop("n_values"))
    # each possible value counts once more than it is kept, so that every one has a code
    kept = first.select("field", F.explode("c.vals").alias("value"))
    book = written(kept.groupBy("field", "value").agg((F.count(F.lit(1)) + 1).alias("n")))
    sums = book.groupBy("field").agg(F.sum(F.col("n") - 1).alias("kept"))
    totals = totals.join(sums, "field", "left").select("field", (F.col("n_values") + F.coalesce("kept", F.lit(0))).alias("total"))
    parsed = _choose(cands, book, totals).where(F.size("c.vals") > 0)
    joined = join_counted(rows, written(parsed), ["field", "text"], "n")
    return joined.select("field", "record_id", F.col("c.dialect").alias("dialect"), F.posexplode("c.vals").alias("pos", "value")).withColumn("pos", (F.col("pos") + 1).cast("int"))
