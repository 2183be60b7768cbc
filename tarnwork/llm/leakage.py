"""Evaluation texts leaking into training text: broadcast n-grams of the test items.

Items and documents are normalised to words (HTML entities decoded, compatibility form,
case folded, format characters removed, runs of letters and digits). All n-word windows of
an item (the whole item if it is shorter) form a set; each document's windows are looked
up in it, and a hit is verified word by word, as the set's keys are the words themselves.
The set is broadcast only when its number of n-grams, counted first, is within
`broadcast_grams`; beyond that windows and n-grams are joined by 128-bit digests of their
words.

Results for edge cases: NULL texts, and items without any word, match nothing; very long
texts are read whole; repeated rows of documents or items count once; empty tables give an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.shaping import salted_join

N = 13
#: An item's n-grams number at most its words; this many take about 200 MB in each worker.
BROADCAST_GRAMS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
#: Format characters (category Cf).
_FORMATS = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")
_WITHOUT_FORMATS = str.maketrans(dict.fromkeys(_FORMATS))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(_folded(text))


def _folded(text: str) -> str:
    return _visible(unicodedata.normalize("NFKC", _visible(unicodedata.normalize("NFKC", text)).casefold()))


def _visible(text: str) -> str:
    return text if _FORMATS.isdisjoint(text) else text.translate(_WITHOUT_FORMATS)


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters of combining class 0 that still may compose with the one before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<" and not unicodedata.combining(second := chr(int(parts[1], 16))):
            found.add(second)
    return frozenset(found)


@lru_cache(maxsize=100_000)
def _begins(c: str) -> bool:
    """Whether normalisation never joins this character with the one before it."""
    first = unicodedata.normalize("NFKD", c)[:1]
    return c not in _FORMATS and not unicodedata.combining(first) and first not in _joining()


def spans(text: str | None) -> list[tuple[int, int]]:
    """Where each word of the normalised text lies in the text itself.

    The text falls into stretches that normalise on their own: an entity or a character with
    those that may join it. Every character they give keeps the place of its stretch.
    """
    text = text or ""
    points: list[tuple[str, int, int]] = []
    at = 0
    for m in _ENTITY.finditer(text) if "&" in text else ():
        points += [(c, at + i, at + i + 1) for i, c in enumerate(text[at : m.start()])]
        points += [(c, *m.span()) for c in html.unescape(m.group())]
        at = m.end()
    points += [(c, at + i, at + i + 1) for i, c in enumerate(text[at:])]
    stretches: list[list] = []
    for c, start, stop in points:
        if stretches and (not _begins(c) or start < stretches[-1][2]):
            stretches[-1][0].append(c)
            stretches[-1][2] = max(stop, stretches[-1][2])
        else:
            stretches.append([[c], start, stop])
    line: list[str] = []
    places: list[tuple[int, int]] = []
    for chars, start, stop in stretches:
        got = _folded("".join(chars))
        line.append(got)
        places += [(start, stop)] * len(got)
    return [(places[m.start()][0], places[m.end() - 1][1]) for m in _WORD.finditer("".join(line))]


def grams_of(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


class GramSet:
    """n-grams -> items, with one table per length and the first two words as a filter."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.tables: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            for g in grams_of(text, n):
                self.tables[len(g)][g].append(item)
        self.tables = {k: dict(t) for k, t in self.tables.items()}
        #: first word -> second words (None for a window of one word), a filter before windows are made
        self.starts: dict[str, set[str | None]] = defaultdict(set)
        for t in self.tables.values():
            for g in t:
                self.starts[g[0]].add(g[1] if len(g) > 1 else None)
        self.starts = dict(self.starts)

    def hits(self, w: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, first word, words) of each window that is an item's n-gram."""
        starts, n = self.starts, len(w)
        for i, first in enumerate(w):
            seconds = starts.get(first)
            if seconds is None or not (None in seconds or (i + 1 < n and w[i + 1] in seconds)):
                continue
            for k, grams in self.tables.items():
                for item in grams.get(tuple(w[i : i + k]), ()) if i + k <= n else ():
                    yield item, i, k


def _batches(df: DataFrame, key: str, text: str, schema: str, arrow: pa.Schema, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = tuple([] for _ in arrow)
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows_of(k, t):
                    for c, x in zip(columns, row, strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null").mapInArrow(run, schema)


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
_WINDOWS = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])
_WINDOW_COLUMNS = "id bigint, pos int, n int, d1 bigint, d2 bigint"


def _distinct_items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()


def _small_set(items: DataFrame, n: int, broadcast_grams: int) -> GramSet | None:
    """The set of all n-grams if it is proven to hold at most broadcast_grams."""
    # an item has no more n-grams than characters, so this bounds the set before it is made
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if size[0] > 4 * broadcast_grams or size[1] > broadcast_grams:
        return None
    grams = GramSet([(r["item_id"], r["text"]) for r in items.toLocalIterator()], n)
    return grams if sum(map(len, grams.tables.values())) <= broadcast_grams else None


def find_leaks(documents: DataFrame, items: DataFrame, n: int = N, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds n consecutive words of the item."""
    items = _distinct_items(items)
    grams = _small_set(items, n, broadcast_grams)
    if grams is None:
        return _hit_windows(documents, items, n).select("doc_id", "item_id").distinct()
    shared = documents.sparkSession.sparkContext.broadcast(grams)
    return _batches(documents, "doc_id", "text", "doc_id bigint, item_id bigint", _HITS, lambda k, t: {(k, item) for item, _, _ in shared.value.hits(words(t))}).distinct()


def _digest(gram: list[str] | tuple[str, ...]) -> tuple[int, int]:
    d = hashlib.blake2b("\x1f".join(gram).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _hit_windows(documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(doc_id, item_id, pos, n) without a broadcast: windows and n-grams are joined by a
    128-bit digest of their words; windows many documents share are spread over salts."""
    wanted = _batches(items, "item_id", "text", _WINDOW_COLUMNS, _WINDOWS, lambda k, t: [(k, 0, len(g), *_digest(g)) for g in grams_of(t, n)])
    lengths = [r["n"] for r in wanted.select("n").distinct().collect()]  # at most n different ones

    def windows(k: int, t: str) -> Iterator[tuple[int, int, int, int, int]]:
        w = words(t)
        for m in lengths:
            for i in range(len(w) - m + 1):
                yield (k, i, m, *_digest(w[i : i + m]))

    have = _batches(documents, "doc_id", "text", _WINDOW_COLUMNS, _WINDOWS, windows).withColumnRenamed("id", "doc_id")
    return salted_join(have, wanted.select(F.col("id").alias("item_id"), "n", "d1", "d2"), ["n", "d1", "d2"], "doc_id").select("doc_id", "item_id", "pos", "n")


_CLEAN = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed", pa.int32())])
_CLEAN_COLUMNS = "doc_id bigint, text string, removed int"


def cut(text: str, marks: list[tuple[int, int]]) -> str:
    """The text without the words from first to last of each mark (first, behind last), and
    without the marks around them where these stand alone between blanks."""
    places = spans(text)
    if marks and len(places) != len(words(text)):
        raise ValueError("the words of a text could not be found in it")
    starts, stops = {a for a, _ in places}, {b for _, b in places}
    out, at = [], 0
    for a, b in sorted({(places[i][0], places[j - 1][1]) for i, j in marks}):
        left, right = a, b
        while left > 0 and not text[left - 1].isspace() and left not in stops:
            left -= 1
        while right < len(text) and not text[right].isspace() and right not in starts:
            right += 1
        # what stands between the passage and another word stays, so that words never grow together
        a, b = a if left in stops else left, b if right in starts else right
        out.append(text[at : max(at, a)])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def remove_leaks(documents: DataFrame, items: DataFrame, n: int = N, whole: bool = False, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, text, removed): documents with the leaked stretches cut out, or without the
    documents that have any if `whole`."""
    items = _distinct_items(items)
    grams = _small_set(items, n, broadcast_grams)
    if grams is not None:
        shared = documents.sparkSession.sparkContext.broadcast(grams)

        def clean(k: int, t: str) -> list[tuple[int, str, int]]:
            marks = [(i, i + m) for _, i, m in shared.value.hits(words(t))]
            if marks and whole:
                return []
            kept = cut(t, marks) if marks else t
            return [(k, kept, len(t) - len(kept))]

        return _batches(documents, "doc_id", "text", _CLEAN_COLUMNS, _CLEAN, clean)

    # a document's marks are at most its words
    marked = _hit_windows(documents, items, n).groupBy("doc_id").agg(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))).alias("marks"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null").join(marked, "doc_id", "left")
    if whole:
        return texts.where("marks is null").select("doc_id", "text", F.lit(0).alias("removed"))

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source, marks = (batch.column(i).to_pylist() for i in range(3))
            kept = [cut(t, [(m["pos"], m["end"]) for m in ms]) if ms else t for t, ms in zip(source, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array([len(a) - len(b) for a, b in zip(source, kept, strict=True)], pa.int32())], schema=_CLEAN)

    return texts.mapInArrow(cut_batches, _CLEAN_COLUMNS)
