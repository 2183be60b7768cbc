"""Long exact spans shared between records: a sparse de Bruijn graph, compacted.

The tokens are characters; k-mers of K characters are the graph's edges. Of all k-mers only
a sample is kept: in every window of LEAST - K + 1 successive k-mers the one with the least
hash (the last of equals), so any stretch of LEAST characters that two texts share holds a
k-mer that is kept in both. Kept k-mers found in two texts or more, linked to the next kept
one of the same text at their distance, form a sparse graph. A link that all occurrences of
both its ends take is nonbranching; such links are compacted by joining occurrence counts,
and each text's run of compacted links is one occurrence of a repeated path. Source
coordinates then verify: paths of LEAST characters or more are compared by a 128-bit
cryptographic digest of their characters, and around shorter ones every stretch of LEAST
characters that contains the path is compared by such a digest. Kept k-mers are known by
such a digest of 64 bits; only the choice of those to keep, which is the same wherever the
characters are, uses a cheap rolling hash.

Work grows with the texts and with the repeated paths, not with pairs: pairs appear only
when two texts hold an equal stretch, and exact copies are one class throughout, which is
expanded only where the result asks for pairs of records.

Results for edge cases: NULL, empty and shorter texts share nothing; repeated rows of a
record count once; a stretch repeated within one record alone is not shared; exact copies
of a long enough text share all of it; empty tables give empty results; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.plans.shaping import anti_checked, join_counted, written

LEAST, K = 300, 200
#: Holders of one stretch that a task may get on the left of their pairs.
SIDE = 1_000

#: The odd base of a polynomial hash modulo 2**64, and a mixing factor for code points.
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PLACE = (1 << 24) - 1
_table: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    if len(_table[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            made = np.full(max(n, 1 << 14), base, np.uint64)
            made[0] = 1
            _table[i] = np.multiply.accumulate(made)
    return _table[0][:n], _table[1][:n]


def encoded(text: str) -> bytes:
    """Four bytes a code point."""
    return text.encode("utf-32-le", "surrogatepass")


def order_hashes(codes: bytes, k: int) -> np.ndarray:
    """A hash of every k-mer of a text, by which some are kept; different k-mers may share one."""
    points = np.frombuffer(codes, np.uint32)
    up, down = _powers(len(points) + 1)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(points)], dtype=np.uint64)])
    h = (sums[k:] - sums[:-k]) * down[: len(points) - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def digests(codes: bytes, starts: list[int], stops: list[int], size: int) -> np.ndarray:
    """Cryptographic digests of stretches of a text, as rows of size / 8 integers."""
    found = b"".join(blake2b(codes[4 * a : 4 * b], digest_size=size).digest() for a, b in zip(starts, stops, strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, size // 8)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Ascending places of the last least hash of every window of w; compares 40 bits of it."""
    found = []
    for at in range(0, max(1, len(h) - w + 1), _PLACE - w):
        part = h[at : at + _PLACE]
        n = len(part)
        if n < w:
            break
        marked = (part & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(n, dtype=np.uint64))
        blocks = -(-n // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = marked
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
        taken = least[np.concatenate([[True], least[1:] != least[:-1]])]
        found.append(at + _PLACE - (taken & np.uint64(_PLACE)).astype(np.int64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def sampled_kmers(text: str, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and digests of the k-mers kept of one text."""
    if len(text) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = encoded(text)
    places = window_minima(order_hashes(codes, k), least - k + 1)
    return places, digests(codes, places.tolist(), (places + k).tolist(), 8)[:, 0]


def path_keys(text: str, runs: list[tuple[int, int]], least: int, k: int, edges: bool) -> list[tuple[int, int]]:
    """Stretches (start, stop) to compare for paths of one text.

    A path of `least` characters or more stands for itself; around a shorter one every
    stretch of `least` characters that contains it is compared. With edges also the
    stretches that reach over either end of a path, which only the coverage needs.
    """
    n, keys, reach = len(text), set(), least - k
    for start, stop in runs:
        if stop - start >= least:
            keys.add((start, stop))
            if edges:
                keys.update((s, s + least) for s in range(max(0, start - reach), start))
                keys.update((s, s + least) for s in range(stop - least + 1, min(stop - k, n - least) + 1))
        elif edges:
            keys.update((s, s + least) for s in range(max(0, start - reach), min(stop - k, n - least) + 1))
        else:
            keys.update((s, s + least) for s in range(max(0, stop - least), min(start, n - least) + 1))
    return sorted(keys)


_KMERS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())])
_KEYS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])


def copy_classes(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, rep) of all documents of at least `least` characters: exact copies share the smallest id."""
    digest = documents.where(F.length("text") >= least).select("doc_id", F.md5("text").alias("m"), F.xxhash64("text").alias("x"), F.length("text").alias("n")).where("doc_id is not null").distinct()
    digest = written(digest)
    reps = written(digest.groupBy("m", "x", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("held")))
    several = reps.where("rep != _last")
    # most texts have no copy: only those of a class of several need the join
    copies = join_counted(digest, several.drop("_last"), ["m", "x", "n"], "held").select("doc_id", "rep")
    single = reps.where("rep = _last").select(F.col("rep").alias("doc_id"), "rep")
    return copies.unionByName(single)


def repeated_paths(documents: DataFrame, classes: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """(doc_id, path, start, stop): every occurrence of every compacted repeated path."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, hashes = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, h = sampled_kmers(text, least, k)
                ids.append(np.full(len(at), doc, np.int64))
                places.append(at.astype(np.int32))
                hashes.append(h)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, places, hashes)], schema=_KMERS)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where((F.length("text") >= least) & F.col("doc_id").isNotNull())
    copies = classes.where("doc_id != rep").select("doc_id")
    kept = written(anti_checked(texts.mapInArrow(sample, "doc_id bigint, pos int, h bigint"), copies, ["doc_id"]))
    several = written(kept.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("held")).where("a != b").select("h", "held"))
    # repeated rows of a record are dropped here, where few k-mers are left
    found = written(join_counted(kept, several, ["h"], "held").drop("held").distinct())
    counts = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    nodes = written(join_counted(found, counts, ["h"], "n"))
    in_text = Window.partitionBy("doc_id").orderBy("pos")
    linked = nodes.withColumns({"next": F.lead("h").over(in_text), "gap": F.lead("pos").over(in_text) - F.col("pos"), "next_n": F.lead("n").over(in_text)})
    # k-mers that overlap fix every character between them
    taken = linked.where(F.col("next").isNotNull() & (F.col("gap") <= k)).groupBy("h", "gap", "next", "n", "next_n").agg(F.count(F.lit(1)).alias("taken"))
    plain = written(taken.where("taken = n and n = next_n").select("h", F.col("n").alias("goes_on")))
    flagged = written(join_counted(nodes.select("doc_id", "pos", "h"), plain, ["h"], "goes_on", how="left").select("doc_id", "pos", "h", F.col("goes_on").isNotNull().alias("goes_on")))
    begins = ~F.coalesce(F.lag("goes_on").over(in_text), F.lit(False))
    numbered = flagged.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(in_text))
    return numbered.groupBy("doc_id", "run").agg(F.min_by("h", "pos").alias("path"), F.min("pos").alias("start"), (F.max("pos") + k).alias("stop")).drop("run")


def shared_stretches(documents: DataFrame, classes: DataFrame, least: int = LEAST, k: int = K, edges: bool = False) -> DataFrame:
    """(doc_id, start, stop, d1, d2): stretches compared, of class representatives; d1 and d2 are
    a cryptographic digest of the characters."""
    runs = repeated_paths(documents, classes, least, k).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = path_keys(text, [(r["start"], r["stop"]) for r in runs if r["stop"] <= len(text)], least, k, edges)
                if keys:
                    starts, stops = zip(*keys, strict=True)
                    for c, x in zip(columns, (np.full(len(keys), doc, np.int64), np.array(starts, np.int32), np.array(stops, np.int32), digests(encoded(text), starts, stops, 16)), strict=True):
                        c.append(x)
            if columns[0]:
                docs, starts, stops, both = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs, starts, stops, both[:, 0], both[:, 1])], schema=_KEYS)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= least)
    # repeated rows of a record lie in one partition after the join, distinct drops them; of one id
    # with several texts, a path is compared in those that are long enough for it
    return texts.join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(digest, "doc_id bigint, start int, stop int, d1 bigint, d2 bigint").distinct()


def shared_pairs(documents: DataFrame, least: int = LEAST, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) between class representatives, membership (doc_id, rep))."""
    classes = written(copy_classes(documents, least))
    keys = written(shared_stretches(documents, classes, least, k).select("doc_id", "d1", "d2").distinct())
    # stretches that lie side by side are mostly held by the same texts: one of each such set is enough
    held_by = keys.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(2))).alias("y")).where("n > 1")
    several = written(held_by.groupBy("n", "x", "y").agg(F.min(F.struct("d1", "d2")).alias("d")).select("d.d1", "d.d2", "n"))
    held = written(join_counted(keys, several, ["d1", "d2"], "n"))
    # a text's partners of one stretch are spread over as many salts as the stretch needs, so that no
    # task gets more than SIDE texts on the left; every pair met is a result
    salts = F.ceil(F.col("n") / SIDE).cast("int")
    left = held.select("d1", "d2", F.col("doc_id").alias("a"), F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("_s"))
    right = held.select("d1", "d2", F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_s"))
    pairs = left.join(right, ["d1", "d2", "_s"]).where("a < b").select("a", "b").distinct()
    return pairs, classes


def class_links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, rep, copies, links): each record with its class of exact copies, the number of
    records in the class, and of other classes that share a stretch with it."""
    both = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep")))
    links = both.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).join(links, "rep", "left")
    counted = join_counted(classes, written(sizes), ["rep"], "copies")
    return counted.select("doc_id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def expand_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: pairs of records, copies included."""
    x, y = classes.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), classes.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = pairs.join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def coverage(documents: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share, copies) of every record with text: how many of
    its characters lie in a stretch of `least` or more that another record holds too."""
    classes = written(copy_classes(documents, least))
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    keys = written(shared_stretches(documents, classes, least, k, edges=True))
    several = keys.groupBy("d1", "d2").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.count(F.lit(1)).alias("n")).where("p != q").select("d1", "d2", "n")
    held = join_counted(keys, written(several), ["d1", "d2"], "n").select("doc_id", "start", "stop")
    in_text = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.coalesce(F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = held.withColumn("fresh", F.greatest(F.col("stop") - F.greatest("start", before), F.lit(0))).groupBy(F.col("doc_id").alias("rep")).agg(F.sum("fresh").alias("part"))
    all_rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars")).where("doc_id is not null and n_chars is not null").distinct()
    joined = all_rows.join(classes, "doc_id", "left").join(sizes, "rep", "left").join(fresh, "rep", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0)))
    return joined.select("doc_id", "n_chars", shared.cast("bigint").alias("shared_chars"), F.round(F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)), 6).alias("share"), F.coalesce("copies", F.lit(1)).alias("copies"))
