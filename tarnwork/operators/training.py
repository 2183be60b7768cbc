"""Training of projections: triplets drawn by hashes, a two-layer perceptron, triplet loss.

Draws are deterministic: the negative of an anchor is the free one with the least hash of
(anchor, candidate, seed) among the candidates it tries, so no shuffle of random numbers and
no sampling of pairs.
"""

from __future__ import annotations

import warnings
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.plans.shaping import checkpoint, small, written

# How much more a triplet of a commit of each kind weighs.
MOMENT_WEIGHTS = {"breaking": 3.0, "big_bang": 2.0, "migration": 1.5, "rewrite": 1.2}
#: Buckets, at least and at most, by which the places of a pool are numbered, and items in each.
BUCKETS, BUCKET_ITEMS = (64, 4_096), 50_000
#: Items that an anchor tries before it may go through as many as it has partners.
TRIES = (8, 64)


def _hash(seed: int, *columns: str) -> Column:
    """60 bits of the MD5 of a seed and columns, which other engines can make too."""
    return F.conv(F.substring(F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *columns)), 1, 15), 16, 10).cast("bigint")


def _placed(pool: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(place, item) of the distinct items in the order of two hashes, places from 0 without gaps, and their number."""
    items = written(pool.select("item").where("item is not null").distinct())
    buckets = min(max(BUCKETS[0], items.count() // BUCKET_ITEMS), BUCKETS[1])
    order = Window.partitionBy("b").orderBy(_hash(seed, "item"), "item")
    laid = checkpoint(items.withColumn("b", F.pmod(_hash(seed + 1, "item"), F.lit(buckets))).withColumn("rn", F.row_number().over(order)))
    sizes = dict(laid.groupBy("b").count().collect())  # at most BUCKETS[1] rows
    before = [sum(sizes.get(x, 0) for x in range(b)) for b in range(buckets)]
    return laid.select((F.get(F.array(*(F.lit(x) for x in before)), F.col("b").cast("int")) + F.col("rn") - 1).cast("bigint").alias("place"), "item"), sum(sizes.values())


def _negatives(anchors: DataFrame, pool: DataFrame, forbidden: DataFrame, seed: int, by: str = "anchor") -> DataFrame:
    """One item of pool(item) per anchor that is no partner in forbidden(by, item); anchors: (anchor, by).

    The pool is laid out by hash and each anchor tries the items from a place of its own on,
    round the end; partners are taken out by an anti-join. Anchors left over try more, at last
    two more than they have partners: one of so many is free, or the whole pool has been tried.
    Those that no item is free for are warned of.
    """
    placed, size = _placed(pool, seed)
    banned = forbidden.select(by, "item").distinct()
    left = checkpoint(anchors.select(*{"anchor": 0, by: 0}).distinct())
    found = None
    for tries in (*TRIES, None):
        if tries is None:
            n_banned = banned.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
            asked = left.join(n_banned, by, "left").withColumn("n", F.coalesce("n", F.lit(0)) + 2)
        else:
            asked = left.withColumn("n", F.lit(tries))
        begin = F.pmod(_hash(seed + 2, "anchor"), F.lit(max(size, 1)))
        steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("n").cast("bigint"), F.lit(size)) - 1))
        tried = asked.where(F.lit(size > 0)).select(*left.columns, steps.alias("k")).withColumn("place", F.pmod(begin + F.col("k"), F.lit(max(size, 1)))).drop("k").join(small(placed), "place").where("item != anchor")
        free = tried.join(banned, [by, "item"], "left_anti")
        best = checkpoint(free.groupBy("anchor").agg(F.min(F.struct(_hash(seed, "anchor", "item").alias("h"), F.col("item"))).alias("x")).select("anchor", F.col("x.item").alias("negative")))
        found = best if found is None else found.unionByName(best)
        left = checkpoint(left.join(best, "anchor", "left_anti"))
        if left.isEmpty():
            return found
    warnings.warn(f"{left.select('anchor').distinct().count()} anchors have no negative: every other item is a partner", stacklevel=3)
    return found


def cochange_triplets(co_changes: DataFrame, least: int = 2, seed: int = 7, both_ways: bool = False) -> DataFrame:
    """(anchor, positive, negative): files that change together, and one that never did.

    A pair's count is the sum of its rows in either order. Its first file is the anchor, with
    both_ways each of the two.
    """
    x, y = F.col("file_a"), F.col("file_b")
    stored = co_changes.where(x != y).groupBy(F.least(x, y).alias("anchor"), F.greatest(x, y).alias("positive")).agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    flipped = lambda df, a, b: df.unionByName(df.select(F.col(b).alias(a), F.col(a).alias(b)))
    pairs = stored.where(F.col("n") >= least).select("anchor", "positive")
    pairs = flipped(pairs, "anchor", "positive") if both_ways else pairs
    both = flipped(stored.select("anchor", F.col("positive").alias("item")), "anchor", "item")
    return pairs.join(_negatives(pairs, both.select("item"), both, seed), "anchor")


def session_triplets(observations: DataFrame, seed: int = 7) -> DataFrame:
    """(anchor, positive, negative): texts of one session (session_id, item), and one of another."""
    obs = observations.select("session_id", "item").distinct()
    next_item = F.lead("item").over(Window.partitionBy("session_id").orderBy(_hash(seed, "item"), "item"))
    pairs = obs.withColumn("positive", next_item).where("positive is not null").select("session_id", F.col("item").alias("anchor"), "positive")
    return pairs.join(_negatives(pairs, obs, obs, seed, by="session_id"), "anchor").select("anchor", "positive", "negative")


def dependency_triplets(calls: DataFrame, seed: int = 7) -> DataFrame:
    pairs = calls.select(F.col("caller").alias("anchor"), F.col("callee").alias("positive")).distinct()
    return pairs.join(_negatives(pairs, pairs.select(F.col("positive").alias("item")), pairs.withColumnRenamed("positive", "item"), seed), "anchor")


def commit_triplets(commits: DataFrame, commit_files: DataFrame, functions: DataFrame, moments: DataFrame, seed: int = 7) -> DataFrame:
    """(anchor message, positive and negative function, weight): functions of touched and untouched files."""
    subject = commits.where(F.length("message") > 30).select("sha", F.col("message").alias("anchor"))
    f = functions.select(F.col("file").alias("file_path"), F.col("name").alias("item")).distinct()
    met = subject.join(commit_files.select("sha", "file_path").distinct(), "sha").join(f, "file_path").select("sha", "anchor", F.col("item").alias("positive"))
    weight = F.lit(1.0)
    for kind, w in MOMENT_WEIGHTS.items():
        weight = F.when(F.col("moment_type") == kind, F.lit(w)).otherwise(weight)
    weighted = met.join(moments.select("sha", "moment_type"), "sha", "left").select("anchor", "positive", weight.alias("weight")).distinct()
    return weighted.join(_negatives(weighted, f, weighted.select("anchor", F.col("positive").alias("item")), seed), "anchor")


class Projection:
    """W2 relu(W1 x + b1) + b2."""

    def __init__(self, inputs: int, hidden: int, outputs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, np.sqrt(2 / inputs), (hidden, inputs)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, np.sqrt(1 / hidden), (outputs, hidden)), np.zeros(outputs)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1.T + self.b1, 0) @ self.w2.T + self.b2

    def save(self, path: str) -> None:
        np.savez(path, w1=self.w1, b1=self.b1, w2=self.w2, b2=self.b2)

    @classmethod
    def load(cls, path: str) -> Projection:
        z = np.load(path)
        p = cls(z["w1"].shape[1], z["w1"].shape[0], z["w2"].shape[0])
        p.w1, p.b1, p.w2, p.b2 = z["w1"], z["b1"], z["w2"], z["b2"]
        return p

    def column(self, spark, vector: Column) -> Column:
        shared = spark.sparkContext.broadcast(self)  # the weights only, their size is fixed

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), dtype=object)
            known = [i for i, x in enumerate(v) if x is not None]
            if known:
                for i, y in zip(known, shared.value(np.stack([np.asarray(v.iloc[i], np.float64) for i in known])), strict=True):
                    out.iloc[i] = y
            return out

        return project(vector)


def _unit(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return y / n, n


def train(p: Projection, triplets: np.ndarray, epochs: int = 20, rate: float = 0.05, margin: float = 0.2) -> list[float]:
    """Gradient descent on max(0, d(a, p) - d(a, n) + margin) over unit outputs; the loss of each epoch.

    triplets: (n, 3, inputs), a bounded sample that the caller drew.
    """
    losses = []
    for _ in range(epochs):
        xs = [triplets[:, i] for i in range(3)]
        hs = [np.maximum(x @ p.w1.T + p.b1, 0) for x in xs]
        us, ns = zip(*(_unit(h @ p.w2.T + p.b2) for h in hs), strict=True)
        d_ap, d_an = us[0] - us[1], us[0] - us[2]
        n_ap, n_an = (np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9) for d in (d_ap, d_an))
        loss = np.maximum(0, n_ap - n_an + margin)
        losses.append(float(loss.mean()))
        on = (loss > 0) / len(loss)
        grads = [on * (d_ap / n_ap - d_an / n_an), on * (-d_ap / n_ap), on * (d_an / n_an)]
        g = {"w1": 0, "b1": 0, "w2": 0, "b2": 0}
        for x, h, u, n, gu in zip(xs, hs, us, ns, grads, strict=True):
            gy = (gu - u * (gu * u).sum(axis=1, keepdims=True)) / n
            gh = (gy @ p.w2) * (h > 0)
            g["w2"] = g["w2"] + gy.T @ h
            g["b2"] = g["b2"] + gy.sum(axis=0)
            g["w1"] = g["w1"] + gh.T @ x
            g["b1"] = g["b1"] + gh.sum(axis=0)
        for name, value in g.items():
            setattr(p, name, getattr(p, name) - rate * value)
    return losses


@lru_cache(maxsize=1 << 18)
def _word_hash(word: str) -> int:
    return int.from_bytes(md5(word.encode()).digest()[:4], "big")


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """Unit vector of signed feature hashes of an array of tokens; stands in for a text model.

    A word's hash is the first 32 bits of its MD5, so that other engines can make the same.
    """

    @F.pandas_udf("array<double>")
    def embed(lists: pd.Series) -> pd.Series:
        out = []
        for words in lists:
            h = np.fromiter((_word_hash(w) for w in (() if words is None else words)), np.int64)
            v = np.bincount(h % size, np.where(h >> 16 & 1, 1.0, -1.0), size) if len(h) else np.zeros(size)
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out, dtype=object)

    return embed(tokens)
