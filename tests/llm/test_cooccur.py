import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tarnwork.llm import cooccur


def counted(spark, data, block=cooccur.BLOCK):
    df = spark.createDataFrame(data, "sha string, file_path string, count bigint, a string")
    members, items, _ = cooccur.encode_items(df, "sha", "file_path")
    sized = cooccur.with_sizes(members)
    out = cooccur.named(cooccur.pair_counts(cooccur.basket_pairs(sized, block)), items)
    return {(r["file_a"], r["file_b"]): r["c"] for r in out.collect()}, sized, items


def brute(data):
    baskets = {}
    for s, f, *_ in data:
        if s is not None and f is not None:
            baskets.setdefault(s, set()).add(f)
    return Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2)), baskets


def test_blocks_give_the_same_pairs_as_brute_force(spark):
    rng = random.Random(3)
    data = [(f"s{rng.randint(0, 20)}", f"f{rng.randint(0, 60)}", 1, "x") for _ in range(600)]
    data += [("huge", f"f{i}", 1, "x") for i in range(60)]  # a basket with a large part of all rows
    data += [data[0], data[1], (None, "f1", 1, ""), ("s1", None, 1, "")]
    want, _ = brute(data)
    for block in (4, 7, 32, 1000):
        assert counted(spark, data, block)[0] == want


def test_hot_baskets_and_items(spark, monkeypatch):
    from tarnwork.plans import shaping

    monkeypatch.setattr(shaping, "BROADCAST_ROWS", 1)
    rng = random.Random(4)
    data = [(f"s{i}", f"f{rng.randint(0, 30)}", 1, "x") for i in range(300) for _ in range(2)] + [(f"s{i}", "hot", 1, "x") for i in range(300)] + [("huge", f"f{i}", 1, "x") for i in range(400)]
    assert counted(spark, data, 16)[0] == brute(data)[0]


def test_lift(spark):
    data = [(s, f, 0, "") for s, f in [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("4", "c")]]
    _, sized, items = counted(spark, data)
    pairs = cooccur.pair_counts(cooccur.basket_pairs(sized))
    support = sized.groupBy("id").agg(F.count(F.lit(1)).alias("support"))
    r = cooccur.with_lift(pairs, support, 4).collect()
    assert len(r) == 1 and r[0]["c"] == 2 and abs(r[0]["lift"] - 2 * 4 / (3 * 2)) < 1e-12


def test_empty_and_single(spark):
    assert counted(spark, [])[0] == {}
    assert counted(spark, [("1", "a", 0, "")])[0] == {}
