"""Splitting oversized texts at natural boundaries, with a sparse-table range-maximum index.

Every boundary of a text has a strength: paragraph 4, line 3, sentence 2, word 1. A sparse
table over the boundaries answers which is the strongest in a range, the rightmost of
equals. A piece that starts at s may end anywhere in (s + least, s + limit]; it ends at the
strongest boundary there, or at s + limit if there is none, and the next piece starts
`overlap` characters before that end.

The same index tells which strength a text needs: for the start of the text and behind every
boundary it is asked for the strongest boundary in the window of `limit` characters from
there. A rank is enough if every window that opens at a boundary of that rank or stronger
holds one again (or the end of the text); the strongest such rank is the need.

Results for edge cases: NULL and empty texts give no pieces; a text within the limit is one
piece; a text without any boundary is cut at the limit (need ``none``); lengths count code
points, CRLF is never cut in two, repeated rows give one set of pieces; extra columns are
not carried along, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = ("none", "word", "sentence", "line", "paragraph")
_BREAKS = re.compile(r"(?P<end>\r?\n)|(?P<stop>(?<=[.!?])(?=\s)|(?<=[。！？]))|(?P<space>\s)")


_SPACE = re.compile(r"\s*")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places to cut before, ascending; their strengths; where the stretch before each ends
    and the one after begins (the white space at a boundary belongs to neither)."""
    places: list[int] = []
    strengths: list[int] = []
    ends: list[int] = []
    starts: list[int] = []

    def put(at: int, strength: int, end: int, start: int) -> None:
        if places and places[-1] == at:
            if strength > strengths[-1]:
                strengths[-1], ends[-1], starts[-1] = strength, min(end, ends[-1]), start
        else:
            places.append(at)
            strengths.append(strength)
            ends.append(end)
            starts.append(start)

    line_at = line_end = 0
    for m in _BREAKS.finditer(text):
        a, b = m.span()
        if m["end"] is not None:
            if not text[line_at:a].strip():  # a line of nothing but blanks
                put(b, 4, line_end, b)
            else:
                put(b, 3, a, b)
                line_end = a
            line_at = b
        elif m["space"] is not None:
            put(b, 1, a, b)
        else:
            put(a, 2, a, _SPACE.match(text, a).end())
    return tuple(np.array(x, np.int64) for x in (places, strengths, ends, starts))


class StrongestCut:
    """Sparse table: the strongest boundary in a range of boundaries, the rightmost of equals."""

    def __init__(self, places: np.ndarray, strengths: np.ndarray, widest: int):
        self.places, self.strengths = places, strengths
        level = (strengths.astype(np.int64) << 40) | np.arange(len(places), dtype=np.int64)
        self.levels = [level]
        step = 1
        while 2 * step <= min(len(places), widest):
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def best(self, low: int, high: int) -> tuple[int, int] | None:
        """(place, strength) of the strongest boundary with low < place <= high."""
        a, b = np.searchsorted(self.places, [low, high], side="right")
        if a >= b:
            return None
        k = int(b - a).bit_length() - 1
        level = self.levels[k]
        i = int(max(level[a], level[b - (1 << k)])) & ((1 << 40) - 1)
        return int(self.places[i]), int(self.strengths[i])

    def strongest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Strength of the strongest of boundaries low to high - 1 of each window, 0 if it is empty."""
        out = np.zeros(len(low), np.int64)
        width = high - low
        depth = np.frexp(np.maximum(width, 1))[1] - 1
        for k in np.unique(depth[width > 0]):
            at = (width > 0) & (depth == k)
            level = self.levels[k]
            out[at] = np.maximum(level[low[at]], level[high[at] - (1 << int(k))]) >> 40
        return out


def need_of(n: int, index: tuple[np.ndarray, ...], limit: int) -> str:
    """The strongest rank whose boundaries, with all stronger ones, leave no stretch over the limit."""
    places, strengths, ends, starts = index
    # within a blank line the stretch has ended where the line before it did
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    begins, own = np.insert(starts, 0, 0), np.insert(strengths, 0, 4)
    low, high = np.arange(len(begins)), np.searchsorted(ends, begins + limit, side="right")
    met = StrongestCut(places, strengths, int((high - low).max())).strongest(low, high)
    met[n - begins <= limit] = 4
    return RANKS[next((rank for rank in (4, 3, 2, 1) if (met[own >= rank] >= rank).all()), 0)]


def pieces_of(text: str, limit: int, overlap: int, least: int) -> tuple[str, list[tuple[int, int, str]]]:
    """(need, [(start, end, rank of the cut that ends it)])."""
    n = len(text)
    if not n:
        return "paragraph", []
    index = boundaries(text)
    need = need_of(n, index, limit)
    if n <= limit:
        return need, [(0, n, "end")]
    cuts, out, s = StrongestCut(index[0], index[1], limit + 1), [], 0
    while n - s > limit:
        found = cuts.best(s + least - 1, s + limit) or cuts.best(s + overlap, s + limit)
        e, strength = found or (s + limit, 0)
        if not found and text[e - 1] == "\r" and text[e] == "\n" and e - 1 > s + overlap:
            e -= 1
        out.append((s, e, RANKS[strength]))
        s = e - overlap
    out.append((s, n, "end"))
    return need, out


_PIECES = "tbl string, record_id string, need string, piece int, start int, stop int, cut string, text string"
_ARROW = pa.schema([("tbl", pa.string()), ("record_id", pa.string()), ("need", pa.string()), ("piece", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("cut", pa.string()), ("text", pa.string())])


def split_texts(df: DataFrame, limit: int = 2000, overlap: int = 200, least: int | None = None) -> DataFrame:
    """Pieces of every text of df(tbl, record_id, text), one row each, with the text's need.

    Narrow: each text is cut where it lies, whatever its length, and nothing is shuffled.
    """
    least = limit // 2 if least is None else least
    if not 0 <= overlap < least <= limit:
        raise ValueError("overlap < least <= limit is required")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = tuple([] for _ in _ARROW)
            size = 0
            for tbl, record, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                need, pieces = pieces_of(text, limit, overlap, least)
                for k, (s, e, rank) in enumerate(pieces):
                    for column, x in zip(rows, (tbl, record, need, k, s, e, rank, text[s:e]), strict=True):
                        column.append(x)
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)
                    rows, size = tuple([] for _ in _ARROW), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)

    return _texts(df).mapInArrow(cut, _PIECES)


_NEEDS = pa.schema([("tbl", pa.string()), ("record_id", pa.string()), ("need", pa.string())])


def text_needs(df: DataFrame, limit: int = 2000) -> DataFrame:
    """(tbl, record_id, need) of every text of df(tbl, record_id, text), without its pieces; narrow."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needs = [need_of(len(t), boundaries(t), limit) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(needs, pa.string())], schema=_NEEDS)

    return _texts(df).mapInArrow(ask, "tbl string, record_id string, need string")


def _texts(df: DataFrame) -> DataFrame:
    return df.select("tbl", F.col("record_id").cast("string"), "text").where(F.col("record_id").isNotNull() & (F.length("text") > 0))


def payload_text(data: str) -> Column:
    """Top-level `content` or `body` of a JSON payload, decoded; NULL if invalid or no text."""
    fields = F.from_json(data, "content string, body string")
    return F.coalesce(fields["content"], fields["body"])
