import random
from collections import defaultdict

import numpy as np
import pytest

from tarnwork.llm import spans

LEAST, K = 30, 20
SCHEMA = "doc_id bigint, text string, h string, pos string, start string"


def text(rng, n, alphabet="abcdefgh "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def brute(docs, least=LEAST):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            where[t[i : i + least]].add(d)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    cover = {}
    for d, t in docs:
        marks = [False] * len(t or "")
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                marks[i : i + least] = [True] * least
        cover[d] = sum(marks)
    return pairs, cover


def check(spark, docs):
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA)
    got = {(r["doc_a"], r["doc_b"]) for r in spans.expand_pairs(*spans.shared_pairs(df, LEAST, K)).collect()}
    known = [(d, t) for d, t in docs if d is not None and t is not None]
    pairs, cover = brute(known)
    assert got == pairs
    measured = {r["doc_id"]: r["shared_chars"] for r in spans.coverage(df, LEAST, K).collect()}
    assert measured == cover
    return pairs


def corpus(seed):
    rng = random.Random(seed)
    shared = [text(rng, n) for n in (29, 30, 31, 45, 200)]
    docs = [(i, text(rng, rng.randint(0, 120)) + rng.choice(shared) + text(rng, rng.randint(0, 80)) + (rng.choice(shared) if rng.random() < 0.4 else "")) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(3)]  # exact copies
    docs += [(200, text(rng, 10) + shared[4][37:]), (201, shared[4][3:60] + text(rng, 9)), (202, shared[3][:30]), (203, shared[3][:29])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_coverage_against_brute_force(spark, seed):
    assert len(check(spark, corpus(seed))) > 50


def test_edge_cases(spark):
    rng = random.Random(9)
    same = text(rng, 64)
    docs = [(1, same), (1, same), (2, same), (3, None), (None, same), (4, ""), (5, "short"), (6, "a" * 90), (7, "b" + "a" * 31), (8, "ab" * 40), (9, "ba" * 20), (10, text(rng, 30) * 3), (11, "光" * 35 + "😀" * 30), (12, "x" + "😀" * 30)]
    assert (1, 2) in check(spark, docs) and (11, 12) in check(spark, docs)


def test_hot_stretch(spark):
    rng = random.Random(4)
    hot = text(rng, 40)
    docs = [(i, (hot if i % 3 == 0 else "") + text(rng, 60)) for i in range(60)]
    assert len(check(spark, docs)) >= 190


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans.expand_pairs(*spans.shared_pairs(df)).count() == 0 and spans.coverage(df).count() == 0


def test_window_minima_and_digests():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for w in (1, 7, 101, 500):
        want = sorted({i + int(np.flatnonzero(h[i : i + w] >> np.uint64(24) == (h[i : i + w] >> np.uint64(24)).min())[-1]) for i in range(len(h) - w + 1)})
        assert spans.window_minima(h, w).tolist() == want
    assert spans.window_minima(h[:3], 4).tolist() == []
    codes = spans.encoded("abcabcabc" * 50)
    a = spans.digests(codes, [0, 3, 6, 1], [90, 93, 96, 91], 16).tolist()
    assert a[0] == a[1] == a[2] != a[3]
    assert len(set(spans.order_hashes(codes, 90).tolist())) == 3


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_texts_that_collide_under_polynomials(spark):
    x, y = thue_morse(1024), thue_morse(1024, 1)
    a, b = (spans.digests(spans.encoded(t), [0], [1024], 16).tolist() for t in (x, y))
    assert a != b
    rng = random.Random(3)
    docs = [(1, x), (2, y), (3, text(rng, 40) + x[100:400]), (4, y[:700] + text(rng, 9))]
    df = spark.createDataFrame([(d, t, "", "", "") for d, t in docs], SCHEMA)
    got = {(r["doc_a"], r["doc_b"]) for r in spans.expand_pairs(*spans.shared_pairs(df)).collect()}
    assert got == brute(docs, 300)[0]


def test_one_header_in_all_texts(spark, monkeypatch):
    """Every k-mer of the header is hot and stands at one place; pairs of its holders use many salts."""
    from tarnwork.plans import shaping

    monkeypatch.setattr(shaping, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(spans, "SIDE", 7)
    rng = random.Random(11)
    header = text(rng, 90)
    docs = [(i, header + text(rng, rng.randint(0, 70))) for i in range(50)]
    assert len(check(spark, docs)) == 50 * 49 // 2


def test_hot_keys_are_not_shuffled(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tarnwork.plans import shaping

    monkeypatch.setattr(shaping, "BROADCAST_ROWS", 2)
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    counts = shaping.written(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    for how in ("inner", "left"):
        joined = shaping.join_counted(big, counts.where("k < 1500"), ["k"], "n", how)
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
        want = big.join(counts.where("k < 1500"), ["k"], how)
        assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_classes_and_links(spark):
    rng = random.Random(5)
    s = text(rng, 40)
    docs = [(1, s + "x"), (2, s + "x"), (2, s + "x"), (3, "y" + s), (4, text(rng, 50)), (5, "short"), (None, s), (6, None)]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA)
    got = sorted(tuple(r) for r in spans.class_links(*spans.shared_pairs(df, LEAST, K)).collect())
    assert got == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)]
    assert spans.class_links(*spans.shared_pairs(df.limit(0), LEAST, K)).count() == 0


def test_production_parameters(spark):
    rng = random.Random(8)
    s = text(rng, 300)
    df = spark.createDataFrame([(1, text(rng, 500) + s, "", "", ""), (2, s + text(rng, 700), "", "", ""), (3, s[1:] + "|" + text(rng, 200), "", "", "")], SCHEMA)
    got = {(r["doc_a"], r["doc_b"]) for r in spans.expand_pairs(*spans.shared_pairs(df)).collect()}
    assert (1, 2) in got and (1, 3) not in got


def test_very_long_text(spark):
    rng = random.Random(6)
    base = text(rng, 400_000)
    df = spark.createDataFrame([(1, base, "", "", ""), (2, text(rng, 100) + base[1000:399_000], "", "", ""), (3, text(rng, 1000), "", "", "")], SCHEMA)
    assert [(r["doc_a"], r["doc_b"]) for r in spans.expand_pairs(*spans.shared_pairs(df)).collect()] == [(1, 2)]
