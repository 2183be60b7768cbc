"""Batches of many queries: the search by blocks finds what the plan for few queries finds, and doesn't pair every query with every document."""

import os
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from conftest import rows
from odd import SF, odd_tables, tables_in
from tarnwork.operators import blocks, fts
from test_queries import table_of


def texts(n: int, seed: int) -> list[tuple]:
    """Frequent and rare words, copies, single words and texts without any."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    made = [" ".join(r.choices(words, [1 / (i + 1) for i in range(300)], k=r.choice((1, 3, 9, 30)))) for _ in range(n - n // 5)]
    return [(f"d{i}", t) for i, t in enumerate(made + r.choices(made, k=n // 5 - 2) + ["", "?!"])]


@pytest.fixture()
def many(monkeypatch):
    """Every batch is one of many queries; several blocks and chunks."""
    monkeypatch.setattr(fts, "BROADCAST_ROWS", 0)
    for name, value in (("FEW_DOCS", 100), ("CHUNK_WORDS", 60), ("GROUPS", 16)):
        monkeypatch.setattr(blocks, name, value)


def asked(spark, docs, step):
    terms = fts.query_terms(spark.createDataFrame([(f"q{i}", t) for i, t in docs[::step]] + [("none", "unheard of"), ("same", docs[0][1])], "query_id string, query string"))
    return fts.index(spark.createDataFrame(docs, "id string, text string"), "id", "text"), terms


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_as_for_few_queries(spark, many, monkeypatch, limit):
    idx, terms = asked(spark, texts(400, limit), 9)
    found = rows(fts.bm25(idx, terms, limit).select("query_id", "doc_id", "score", "rank"))
    monkeypatch.setattr(fts, "BROADCAST_ROWS", 20_000)
    assert found == rows(fts.bm25(idx, terms, limit).select("query_id", "doc_id", "score", "rank"))


def test_no_pair_leaves_its_task(spark, many):
    """Before, every pair of a query and a document that share a word was summed up in a shuffle."""
    docs = [(f"d{i}", f"the same w{i % 7}") for i in range(500)]
    idx, terms = asked(spark, docs, 1)
    made = []
    kept = blocks.written
    blocks.written = lambda df: made.append(out := kept(df)) or out
    try:
        found = fts.bm25(idx, terms, 10)
    finally:
        blocks.written = kept
    assert found.count() == 501 * 10
    assert max(t.count() for t in made) <= 502


def test_few_words_too_many_pairs(spark, monkeypatch):
    """A batch that would still be broadcast, but has many words."""
    idx, terms = asked(spark, texts(100, 3), 1)
    want = rows(fts.bm25(idx, terms).select("query_id", "doc_id", "score", "rank"))
    used = []
    kept = blocks.best
    monkeypatch.setattr(blocks, "best", lambda *a: used.append(1) or kept(*a))
    monkeypatch.setattr(fts, "MANY_WORDS", 100)
    assert rows(fts.bm25(idx, terms).select("query_id", "doc_id", "score", "rank")) == want
    assert used


def test_no_documents_and_no_queries(spark, many):
    idx, terms = asked(spark, texts(100, 1), 9)
    assert fts.bm25(idx.limit(0), terms).count() == 0
    assert blocks.best(idx, terms.limit(0), 10).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_best_of_a_block(seed):
    """Against whole sums, with weights that let the search leave words for later or not."""
    r = np.random.default_rng(seed)
    n, limit = 5000, 10
    lists = [np.sort(r.choice(n, int(c), replace=False)) for c in (3, 40, 400, 900, 2000, 4500)]
    part = [np.round(r.uniform(0.2, 2.2, len(d)), 1) for d in lists]
    idf = np.array([7, 5, 2.5, 1.5, 0.4, 1e-6])[: r.integers(1, 7)] if seed % 2 else np.full(6, 1e-6 if seed % 4 else 0.3)
    s = blocks._Search(np.concatenate(lists), np.concatenate(part), np.cumsum([0, *map(len, lists)]), {str(i): i for i in range(6)}, n, limit)
    for _ in range(2):
        at, score = s.best([*map(str, range(len(idf)))], idf)
        sums, seen = np.zeros(n), np.zeros(n, bool)
        for d, p, w in zip(lists, part, idf):
            sums[d] += w * p
            seen[d] = True
        want = sorted(((-np.floor(x * 1e6 + 0.5) / 1e6, i) for i, x in enumerate(sums) if seen[i]))[:limit]
        assert sorted(zip((-score).tolist(), at.tolist())) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", ["belief_self_retrieval", "bm25_documents"])
def test_queries_of_many_words(spark, many, monkeypatch, tmp_path, name, kind):
    """On odd tables as their SQL, each by the search by blocks."""
    used = []
    kept = blocks.best
    monkeypatch.setattr(blocks, "best", lambda *a: used.append(1) or kept(*a))
    folder = odd_tables(tmp_path, kind)
    df = entry.queries()[name](spark, folder)
    want = tables_in(folder).sql(entry.oracle_sql()[name])
    assert table_of(df.columns, df.collect()) == table_of(want.columns, want.fetchall())
    assert used or kind == "empty"
