import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.chunking import RANKS, StrongestCut, boundaries, need_of, pieces_of, split_texts, text_needs


def need(text, limit):
    return need_of(len(text), boundaries(text), limit)


def test_needs():
    assert need("a" * 10 + "\n \n" + "b" * 10, 10) == "paragraph"
    assert need("a" * 10 + "\r\n\r\n" + "b" * 10, 10) == "paragraph"
    assert need("a" * 10 + "\n" + "b" * 10, 10) == "line"
    assert need("a" * 9 + ". " + "b" * 10, 10) == "sentence"
    assert need("光" * 9 + "。" + "水" * 10, 10) == "sentence"
    assert need("a" * 10 + " " + "b" * 10, 10) == "word"
    assert need("a" * 21, 10) == "none"
    assert need("1.5" * 7, 10) == "none"
    assert need("a" * 11 + "\n\n" + "b. c", 10) == "none"


def gaps_need(text, limit):
    """By the longest stretch between successive boundaries of each rank."""
    _, strengths, ends, starts = boundaries(text)
    for rank in (4, 3, 2, 1):
        at = strengths >= rank
        if (np.append(ends[at], len(text)) - np.insert(starts[at], 0, 0)).max() <= limit:
            return RANKS[rank]
    return "none"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc .!\n\r\t。光", max_size=300), st.integers(1, 60))
def test_needs_from_windows_against_gaps(text, limit):
    assert need(text, limit) == gaps_need(text, limit)


def test_needs_of_random_texts():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b" * rng.randint(1, 9), " ", "\n", "\n\n", "\n \t\n", ". ", "。", "\r\n", "  "]) for _ in range(rng.randint(0, 60)))
        limit = rng.randint(1, 40)
        assert need(text, limit) == gaps_need(text, limit), (text, limit)


def test_needs_frame(spark):
    data = [("t", "1", "a b " * 1000, "clash"), ("t", "2", None, ""), ("t", None, "x", ""), ("t", "3", "", ""), ("t", "4", "y" * 2001, ""), ("t", "5", "short", "")]
    df = spark.createDataFrame(data, "tbl string, record_id string, text string, need string")
    assert {(r["record_id"], r["need"]) for r in text_needs(df).collect()} == {("1", "word"), ("4", "none"), ("5", "paragraph")}
    assert text_needs(df.limit(0)).count() == 0


def brute_best(places, strengths, low, high):
    got = [(s, p) for p, s in zip(places, strengths, strict=True) if low < p <= high]
    return (max(got)[1], max(got)[0]) if got else None


def test_sparse_table_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        places = sorted(rng.sample(range(1, 400), rng.randint(0, 80)))
        strengths = [rng.randint(1, 4) for _ in places]
        table = StrongestCut(np.array(places, np.int64), np.array(strengths, np.int64), 400)
        for _ in range(20):
            low = rng.randint(0, 399)
            high = rng.randint(low, 400)
            assert table.best(low, high) == brute_best(places, strengths, low, high)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!\n\r。光", max_size=300), st.integers(10, 60))
def test_pieces_cover_overlap_and_fit(text, limit):
    overlap = limit // 5
    _, pieces = pieces_of(text, limit, overlap, limit // 2)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, _), (s2, _, _) in zip(pieces, pieces[1:], strict=False):
        assert s2 == e - overlap
    assert all(0 < e - s <= limit for s, e, _ in pieces)
    assert "".join(text[(s if i == 0 else s + overlap) : e] for i, (s, e, _) in enumerate(pieces)) == text


def test_strongest_rightmost_cut():
    text = "x" * 30 + "\n\n" + "y" * 10 + "\n" + "z" * 10 + ". " + "w" * 60
    _, pieces = pieces_of(text, 60, 5, 20)
    assert pieces[0] == (0, 32, "paragraph")
    two = "x" * 30 + "\n" + "y" * 10 + "\n" + "z" * 80
    assert pieces_of(two, 60, 5, 20)[1][0] == (0, 42, "line")


def test_frame(spark):
    data = [("t", "1", "a b " * 1000, "clash"), ("t", "1", "a b " * 1000, "clash"), ("t", "2", None, ""), ("t", None, "x", ""), ("t", "3", "", ""), ("t", "4", "short", "")]
    df = spark.createDataFrame(data, "tbl string, record_id string, text string, piece string")
    out = split_texts(df).distinct().collect()
    assert {r["record_id"] for r in out} == {"1", "4"}
    assert max(len(r["text"]) for r in out) <= 2000 and {r["need"] for r in out if r["record_id"] == "1"} == {"word"}
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, 100, 80, 50)


def test_very_long_text():
    need_, pieces = pieces_of(("word " * 40 + "\n") * 10_000, 2000, 200, 1000)
    assert need_ == "line" and len(pieces) > 1000 and need_ in RANKS
