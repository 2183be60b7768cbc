"""BM25 for batches of many queries: blocks of documents meet chunks of queries, and no pair of a
query and a document leaves a task unless it is among the query's best of its block.

Queries of the same words are searched once. A search takes the words that can add most first; once
the remaining ones together can't lift an unseen document to the best, they are only looked up for
the documents that still can get there. Scores are whole sums: nothing is estimated or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.plans.shaping import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Documents and words of a block at most, documents that are worth a block of their own, and words of a chunk of queries.
BLOCK_DOCS, BLOCK_WORDS, FEW_DOCS, CHUNK_WORDS = 60_000, 5_000_000, 30_000, 20_000
#: Scores are rounded to 6 places; documents whose sums are closer than this may be equal.
NEAR = 2e-6
#: Groups of a block's documents whose best ones tell what a query's best ones have at least.
GROUPS = 512


def best(idx: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score, rank) as fts.bm25(); idx: one row a document, terms: (query_id, term)."""
    n = idx.select("doc_id").count()
    n_blocks = max(-(-n // BLOCK_DOCS), min(idx.sparkSession.sparkContext.defaultParallelism, -(-n // FEW_DOCS)), 1)
    kind = idx.schema["doc_id"].dataType.simpleString()
    blocks = written(idx.select("doc_id", "tokens").coalesce(n_blocks).mapInArrow(_blocks, f"ids array<{kind}>, lens binary, words array<string>, starts binary, docs binary, tfs binary, n_docs bigint, sum_len bigint"))
    n_docs, sum_len = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("sum_len"), F.lit(0))).first()
    held = blocks.select("words", "starts").mapInArrow(_held, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))

    asked = written(terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("words")))
    sets = written(asked.select("words").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    known = written(sets.select("set_id", F.explode("words").alias("term")).join(held, "term").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("words")))
    total = known.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n_chunks = max(1, -(-total // CHUNK_WORDS))
    chunk = F.pmod(F.xxhash64("set_id"), F.lit(n_chunks)).alias("chunk")
    chunks = written(known.select(chunk, F.struct("set_id", "words").alias("s")).repartition(n_chunks, "chunk").groupBy("chunk").agg(F.collect_list("s").alias("sets")).select("sets"))

    avg_len = sum_len / n_docs if sum_len else 1.0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, n_docs, avg_len, limit)

    # every task reads one share of either side from the shared folder; nothing is shuffled or broadcast
    met = blocks.select("ids", "lens", "words", "starts", "docs", "tfs").hint("shuffle_replicate_nl").crossJoin(chunks)
    found = met.mapInArrow(search, f"set_id bigint, doc_id {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= limit)
    ids = asked.join(sets, "words").select("query_id", "set_id")
    return written(ranked).join(ids, "set_id").select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens) to one row a block: documents in order of their ids, postings by word."""
    kept, docs, words = [], 0, 0
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            ids, tokens = part.columns
            # of the words only their codes are kept, and each part's different words
            kept.append((ids, pc.list_value_length(tokens).to_numpy(zero_copy_only=False), tokens.flatten().dictionary_encode()))
            docs, words = docs + len(ids), words + len(kept[-1][2])
            if docs >= BLOCK_DOCS or words >= BLOCK_WORDS:
                yield _block(kept)
                kept, docs, words = [], 0, 0
    if docs:
        yield _block(kept)


def _block(parts: list[tuple[pa.Array, np.ndarray, pa.DictionaryArray]]) -> pa.RecordBatch:
    """parts: ids, numbers of words and words of documents."""
    ids = pa.concat_arrays([p[0] for p in parts])
    order = pc.sort_indices(ids)
    place = np.empty(n := len(ids), np.int64)
    place[order.to_numpy()] = np.arange(n)
    ids, laid = ids.take(order), np.concatenate([p[1] for p in parts]).astype(np.int64)
    lens = laid[order.to_numpy()]
    coded = pa.chunked_array([p[2] for p in parts]).unify_dictionaries()
    words = coded.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
    post, tf = np.unique(codes * np.int64(n) + np.repeat(place, laid), return_counts=True)
    starts = np.searchsorted(post, np.arange(len(words) + 1) * n)
    one = lambda a: pa.array([a.tobytes()], pa.binary())
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [whole(ids), one(lens), whole(words), one(starts.astype(np.int64)), one((post % n).astype(np.int32)), one(tf.astype(np.int32)), pa.array([n], pa.int64()), pa.array([int(lens.sum())], pa.int64())],
        names=["ids", "lens", "words", "starts", "docs", "tfs", "n_docs", "sum_len"],
    )


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of its block hold each word."""
    for b in batches:
        for words, starts in zip(b.column(0), b.column(1), strict=True):
            n = np.diff(np.frombuffer(starts.as_buffer(), np.int64))
            yield pa.RecordBatch.from_arrays([words.values, pa.array(n, pa.int64())], names=["term", "n"])


def _searched(batches: Iterator[pa.RecordBatch], n_docs: int, avg_len: float, limit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            ids, words, sets = (b.column(name)[r].values for name in ("ids", "words", "sets"))
            lens, starts, docs, tf = (np.frombuffer(b.column(name)[r].as_buffer(), t) for name, t in (("lens", np.int64), ("starts", np.int64), ("docs", np.int32), ("tfs", np.int32)))
            docs = docs.astype(np.intp)
            part = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lens / avg_len))[docs])
            search = _Search(docs, part, starts, {w: i for i, w in enumerate(words.to_pylist())}, len(ids), limit)
            sizes, pairs = pc.list_value_length(sets.field("words")).to_numpy(), sets.field("words").flatten()
            held = pairs.field("n").to_numpy()
            idf, terms = np.maximum(np.log((n_docs - held + 0.5) / (held + 0.5)), LEAST_IDF), pairs.field("term").to_pylist()
            ends = np.cumsum(sizes)
            found = [search.best(terms[e - s : e], idf[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
            if not found:
                continue
            at, score = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            set_ids = np.repeat(sets.field("set_id").to_numpy(), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(set_ids), ids.take(pa.array(at)), pa.array(score)], names=["set_id", "doc_id", "score"])


class _Search:
    """Postings of a block: of word i, docs (ascending) and what each adds, times the word's idf."""

    def __init__(self, docs: np.ndarray, part: np.ndarray, starts: np.ndarray, words: dict[str, int], n: int, limit: int):
        self.docs, self.part, self.starts, self.words, self.n, self.limit = docs, part, starts, words, n, limit
        self.most = np.maximum.reduceat(part, starts[:-1]) if len(part) else np.zeros(0)
        self.sums = np.zeros(n)

    def best(self, terms: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and rounded scores of the best documents; of equal ones the first."""
        here = [(i, w) for t, w in zip(terms, idf.tolist(), strict=True) if (i := self.words.get(t)) is not None]
        if not here:
            return np.zeros(0, np.int64), np.zeros(0)
        at, weight = np.array([i for i, _ in here]), np.array([w for _, w in here])
        order = np.argsort(-weight * self.most[at], kind="stable")
        at, weight = at[order], weight[order]
        starts, ends = self.starts[at], self.starts[at + 1]
        # what the words after the first k can add at most, and how many postings they have
        rest = np.append(np.cumsum((weight * self.most[at])[::-1])[::-1], 0.0).tolist()
        more = np.append(np.cumsum((ends - starts)[::-1])[::-1], 0).tolist()
        starts, ends, weight = starts.tolist(), ends.tolist(), weight.tolist()
        sums, k = self.sums, len(here)
        sums.fill(0.0)
        cut, done, told = 0.0, k, 0
        for i in range(k):
            a, b = starts[i], ends[i]
            np.add.at(sums, self.docs[a:b], weight[i] * self.part[a:b])
            # worth asking where the words so far can outweigh the others and those have many postings
            if i + 1 < k and (rest[i + 1] >= rest[0] / 2 or more[i + 1] <= self.n // 4 or (k > 8 and more[told] - more[i + 1] < self.n // 4)):
                continue
            told = i + 1
            if (least := _least(sums, self.limit) - NEAR) > rest[i + 1]:
                cut = least - rest[i + 1]
                # a look-up takes about as long as eight postings
                if 8 * (k - i - 1) * np.count_nonzero(sums >= cut) < more[i + 1]:
                    done = i + 1
                    break
        if done == k:
            cut = _least(sums, self.limit) - NEAR
        near = np.flatnonzero(sums >= cut if cut > 0 else sums > 0)
        score = sums[near]
        for i in range(done, k):
            a, b = starts[i], ends[i]
            own = self.docs[a:b]
            found = np.minimum(np.searchsorted(own, near), b - a - 1)
            score += np.where(own[found] == near, weight[i] * self.part[a:b][found], 0.0)
            if len(near) > 4 * self.limit:
                keep = score >= _least(score, self.limit) - rest[i + 1] - NEAR
                near, score = near[keep], score[keep]
        score = np.floor(score * 1e6 + 0.5)
        if len(near) > self.limit:
            keep = score >= _least(score, self.limit)
            near, score = near[keep], score[keep]
            least = np.partition(score, len(score) - self.limit)[len(score) - self.limit]
            above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
            keep = np.concatenate([above, equal[: self.limit - len(above)]])
            near, score = near[keep], score[keep]
        return near, score / 1e6


def _least(values: np.ndarray, k: int) -> float:
    """A value that at least k of values reach, 0 if there are fewer; of many values it is the k-th
    of the largest ones of GROUPS groups, which is found in one pass."""
    if len(values) < k:
        return 0.0
    if len(values) >= 4 * GROUPS and k <= GROUPS // 4:
        values = values[: len(values) // GROUPS * GROUPS].reshape(-1, GROUPS).max(axis=0)
    return float(np.partition(values, len(values) - k)[len(values) - k])
