import random

import pytest
from pyspark.sql import functions as F

from tarnwork.llm import mixture
from tarnwork.plans.shaping import checkpoint

TARGETS = "source string, target_share double, max_repeats int, tokens string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    names = ["big"] * 300 + [" Mid "] * 80 + ["small"] * 6 + [None] * 10
    docs = [(i, "word " * rng.randint(5, 60), s, "clash") for i, s in enumerate(names)]
    docs += [docs[0], docs[0], (None, "x", "big", ""), (9998, None, "big", ""), (9999, "", "MID", "")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens string")


def build(spark, corpus, targets):
    sized = mixture.sized_documents(corpus)
    return sized, planned(spark, sized, targets)


def planned(spark, sized, targets):
    return mixture.plan(sized, checkpoint(mixture.source_budgets(sized, spark.createDataFrame(targets, TARGETS))))


def test_shares_and_caps(spark, corpus):
    sized, budgets = build(spark, corpus, [("big", 0.5, 1, ""), ("mid", 0.3, 2, ""), ("small", 0.15, 3, ""), ("none", 0.05, 9, "")])
    total = sized.agg(F.sum("tokens")).first()[0]
    drawn = mixture.mix(sized, budgets).toPandas()
    got = drawn.assign(t=drawn.tokens * drawn.copies).groupby("source").t.sum()
    largest = drawn.tokens.max()
    assert total * 0.5 * 0.5 - largest <= got["big"] <= total * 0.5 * 0.5
    assert total * 0.5 * 0.3 - largest <= got["mid"] <= total * 0.5 * 0.3
    rows = {r["target"]: r for r in mixture.reached(sized, budgets).collect()}
    assert rows["small"]["short"] and rows["small"]["most_copies"] == 3 and rows["none"]["short"] and rows["none"]["tokens"] == 0
    assert not rows["big"]["short"] and abs(sum(r["share"] for r in rows.values()) - 1) < 1e-9
    assert drawn.doc_id.is_unique and (drawn.groupby("source").copies.max() <= [1, 2, 3]).all()


def test_repeats_and_nested_thresholds(spark, corpus):
    small, budgets = build(spark, corpus, [("mid", 0.2, 5, "")])
    more = planned(spark, small, [("mid", 0.3, 5, "")])
    a, b = ({r["doc_id"]: r["copies"] for r in mixture.mix(small, x).collect()} for x in (budgets, more))
    assert all(b.get(k, 0) >= v for k, v in a.items()) and sum(b.values()) > sum(a.values())


def test_short_at_the_very_edge(spark, corpus):
    sized = mixture.sized_documents(corpus)
    total = sized.agg(F.sum("tokens")).first()[0]
    have = sized.where("source = 'small'").agg(F.sum("tokens")).first()[0]
    for more, short in ((-0.25, False), (0.0, False), (0.25, True)):
        rows = mixture.reached(sized, planned(spark, sized, [("small", 2 * (3 * have + more) / total, 3, "")])).collect()
        assert rows[0]["short"] == short and rows[0]["most_copies"] == 3


def test_odd_targets(spark, corpus):
    sized = mixture.sized_documents(corpus)
    got = {r["target"]: (r["short"], r["tokens"]) for r in mixture.reached(sized, planned(spark, sized, [("big", 0.2, 0, ""), ("mid", 0.0, 2, ""), (None, 0.1, 2, ""), ("gone", 0.1, None, ""), ("small", None, 2, "")])).collect()}
    assert got == {"big": (True, 0), "mid": (False, 0), None: (True, 0), "gone": (True, 0), "small": (False, 0)}


def test_empty_tables(spark, corpus):
    sized, budgets = build(spark, corpus.limit(0), [("mid", 0.2, 5, "")])
    assert mixture.mix(sized, budgets).count() == 0 and mixture.reached(sized, budgets).count() == 1
    sized, budgets = build(spark, corpus, [])
    assert mixture.reached(sized, budgets).count() == 0


def test_tokens_and_names(spark):
    df = spark.createDataFrame([(" A ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(mixture.source_key(F.col("s"))).collect()] == ["a", None, None]
    long = spark.createDataFrame([("hello world " * 100_000,), (None,), ("",)], "t string")
    assert [r[0] for r in long.select(mixture.token_count(F.col("t"))).collect()] == [200_001, 0, 0]
