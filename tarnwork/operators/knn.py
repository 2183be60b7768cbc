"""Nearest neighbours by cosine: exact in blocks, and through an inverted-list index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.vectors import cosine
from tarnwork.plans.shaping import table, written

#: A block of query vectors is broadcast; more queries are answered in several blocks.
BLOCK_VALUES = 8_000_000
#: Scores that a task holds at a time.
SCORES = 4_000_000
#: Rows, at most, to which an index's centres are fitted; every row is indexed.
FIT_ROWS = 20_000

_HITS = "query_id bigint, vec_id bigint, score double"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.asarray(column.value_lengths())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return np.asarray(column.flatten(), np.float64).reshape(len(sizes), -1)


def unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


_NONE = -(1 << 40)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores (in units of 1e-9) of each row and their ids, ties by smaller id."""
    k = min(k, scores.shape[1])
    # one number orders by score, then by place among the ids
    order = np.argsort(ids, kind="stable")
    key = scores[:, order] * (1 << 22) - np.arange(len(ids), dtype=np.int64)
    at = order[np.argpartition(-key, k - 1, axis=1)[:, :k]]
    return np.take_along_axis(scores, at, axis=1), ids[at]


class _Running:
    """The k best hits so far of each query of a block."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int, skip_self: bool):
        self.query_ids, self.q, self.k = query_ids, q, k
        self.order = np.argsort(query_ids) if skip_self else None
        self.scores, self.ids = np.full((len(q), k), _NONE), np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, vec_ids: np.ndarray, m: np.ndarray) -> None:
        width = min(1 << 21, max(1, SCORES // len(self.q)))
        for i in range(0, len(m), width):
            ids = vec_ids[i : i + width]
            scores = np.rint((self.q @ m[i : i + width].T) * 1e9).astype(np.int64)
            if self.order is not None:
                at = np.minimum(np.searchsorted(self.query_ids, ids, sorter=self.order), len(self.q) - 1)
                own = self.query_ids[self.order[at]] == ids
                scores[self.order[at[own]], np.flatnonzero(own)] = _NONE
            best, found = _best(scores, ids, self.k)
            best, found = np.concatenate([self.scores, best], axis=1), np.concatenate([self.ids, found], axis=1)
            at = np.lexsort((found, -best), axis=1)[:, : self.k]
            self.scores, self.ids = np.take_along_axis(best, at, axis=1), np.take_along_axis(found, at, axis=1)

    def batch(self) -> pa.RecordBatch:
        row, column = np.nonzero(self.scores > _NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.query_ids[row]), pa.array(self.ids[row, column]), pa.array(self.scores[row, column] / 1e9)], schema=_ARROW)


def _top(hits: DataFrame, k: int) -> DataFrame:
    ranked = hits.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, skip_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of vectors(vec_id, embedding) to each query.

    queries: (query_id, embedding), unique by query_id, read block by block: a block of at most
    BLOCK_VALUES numbers passes through the driver and is released before the next. Each task
    multiplies its vectors with the block and keeps the k best of each query, so k rows per
    query and task reach the shuffle. A vector is not its own neighbour if skip_self. Zero
    vectors have similarity 0; NULL vectors are left out; vectors of another length are an error.
    """
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("bigint"), "embedding")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n * (width or 1) // BLOCK_VALUES))
    parts = asked if blocks == 1 else written(asked.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition("_b").sortWithinPartitions("_b"))
    out = None
    for b in range(blocks):
        rows = (parts if blocks == 1 else parts.where(F.col("_b") == b)).toArrow()
        if not rows.num_rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((np.asarray(rows["query_id"]), unit(_matrix(rows["embedding"].combine_chunks()))))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Running(*shared.value, k, skip_self)
            for batch in batches:
                if batch.num_rows:
                    m = unit(_matrix(batch.column(1)))
                    if m.shape[1] != best.q.shape[1]:
                        raise ValueError("vectors differ in length")
                    best.add(np.asarray(batch.column(0)), m)
            yield best.batch()

        hits = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(search, _HITS)
        if blocks > 1:
            hits = written(hits)
            shared.destroy()
        out = hits if out is None else out.unionByName(hits)
    return _top(vectors.sparkSession.createDataFrame([], _HITS) if out is None else out, k)


def fit_centres(vectors: DataFrame, lists: int, rounds: int = 15, rows: int = FIT_ROWS) -> np.ndarray:
    """Centres of spherical k-means over at most `rows` vectors, drawn by the hash of their ids."""
    sample = vectors.where("embedding is not null").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id")).limit(rows).toArrow()
    if not sample.num_rows:
        return np.empty((0, 0))
    m = unit(_matrix(sample["embedding"].combine_chunks()))
    centres = m[:: max(1, len(m) // lists)][:lists].copy()
    for _ in range(rounds):
        owner = np.argmax(m @ centres.T, axis=1)
        for c in range(len(centres)):
            if (owner == c).any():
                centres[c] = m[owner == c].mean(axis=0)
        centres = unit(centres)
    return centres


def build_index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row with its list (the nearest centre); written partitioned by list, a probe reads few files."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unit(_matrix(batch.column(1)))
            owner = np.argmax(m @ shared.value.T, axis=1) if len(m) and len(shared.value) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owner.astype(np.int32))], names=["vec_id", "embedding", "list"])

    return vectors.where("embedding is not null").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>")).mapInArrow(assign, "vec_id bigint, embedding array<float>, list int")


def probe_index(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
    """k nearest among the `probes` lists nearest to each query: an equi-join on the list."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unit(_matrix(batch.column(1)))
            near = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes] if len(m) and len(shared.value) else np.empty((len(m), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    rows = queries.where("query_id is not null and embedding is not null")
    asked = rows.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<float>")).mapInArrow(lists, "query_id bigint, q array<float>, lists array<int>")
    met = index.join(asked.withColumn("list", F.explode("lists")).drop("lists"), "list").where("vec_id != query_id")
    return _top(met.select("query_id", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("score")), k)


def every_hundredth(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """The embeddings and, as queries, all rows whose id is divisible by 100."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
