"""Mixing sources to target weights by hash-threshold histograms, without sorting.

Sizes are tokens of a public tokenizer. Every document has a hash that is uniform over
[0, 2**BITS). A source of A tokens that must give T tokens uses all its documents
floor(T / A) times, at most once less than its cap, and once more those whose hash lies
under a threshold. The threshold is found by nested histograms: tokens are summed by source
and the hash's leading bits, the bucket in which the budget runs out is kept and refined by
its next bits, and so on; only that bucket's documents are read again. A budget that runs
out in no bucket leaves the threshold at the top; what is left of it then tells that the
source is short. The filter hash < threshold then draws the documents, and is nested: a
larger budget keeps all documents of a smaller one.

Results for edge cases: NULL or empty texts have 0 tokens; documents without source count
towards the corpus but belong to no source; sources compare without case and outer blanks;
repeated rows of a document count once; of several targets of one source the largest share
and cap hold; targets without documents are reported with 0 and
are short if they have a share; a cap under 1 (or NULL) admits no copy;
ties of hashes fall on the same side of the threshold; empty tables give shares of 0.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.plans.shaping import checkpoint, join_checked

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (published with the tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEP_BITS, STEPS = 11, 4
BITS = STEP_BITS * STEPS


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = _tokenizer(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


def source_key(column: Column) -> Column:
    """Lower case without outer blanks; NULL for an empty name."""
    key = F.lower(F.regexp_replace(column, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when(key != "", key)


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, hash), one row per doc_id, written to the checkpoint folder."""
    sized = documents.select("doc_id", source_key(F.col("source")).alias("source"), token_count(F.col("text"), vocabulary).alias("tokens")).where("doc_id is not null")
    once = sized.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("tokens").cast("bigint").alias("tokens"))
    return checkpoint(once.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - BITS)))


def source_budgets(sized: DataFrame, targets: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(source, target_share, max_repeats, available, need, repeats, rest), one row a target.

    need is target_share of fraction of the corpus; repeats: how often every document is used
    before the draw, which may use it once more; rest: tokens still to be drawn.
    """
    corpus = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    available = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("available"))
    of_source = Window.partitionBy("source")  # over the table of targets
    wanted = targets.select(F.col("source").alias("target"), source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    wanted = wanted.withColumns({c: F.max(c).over(of_source) for c in ("target_share", "max_repeats")}).distinct()
    need = F.coalesce("target_share", F.lit(0.0)) * F.lit(corpus * fraction)
    met = wanted.join(available, "source", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "need": need, "max_repeats": F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))})
    whole = F.floor(F.col("need") / F.greatest("available", F.lit(1)))
    met = met.withColumn("repeats", F.greatest(F.least(whole, F.col("max_repeats") - 1), F.lit(0)).cast("int"))
    return met.withColumn("rest", F.col("need") - F.col("available") * F.col("repeats"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold, left): documents with hash < threshold hold at most `rest` tokens, and
    `left` of rest is not used. Where no bucket uses it up the threshold is 2**BITS or more."""
    state = checkpoint(budgets.where("rest > 0 and source is not null").select("source", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("low")).dropDuplicates(["source"]))
    for step in range(STEPS):
        shift = BITS - STEP_BITS * (step + 1)
        docs = sized.where("source is not null").select("source", "tokens", F.shiftright("hash", shift).alias("bucket"))
        inside = join_checked(docs, state, ["source"], "bucket").where(F.shiftright("bucket", STEP_BITS) == F.shiftright("low", BITS - STEP_BITS * step) if step else F.lit(True))
        # at most 2**STEP_BITS buckets a source leave this aggregation
        summed = inside.groupBy("source", "left", "low", "bucket").agg(F.sum("tokens").alias("tokens"))
        upto = Window.partitionBy("source").orderBy("bucket")
        running = summed.withColumn("total", F.sum("tokens").over(upto))
        edges = running.groupBy("source").agg(F.min(F.when(F.col("total") > F.col("left"), F.struct("bucket", "total", "tokens"))).alias("x"), F.sum("tokens").alias("all"))
        edges = edges.select("source", F.col("x.bucket").alias("edge"), F.coalesce(F.col("x.total") - F.col("x.tokens"), F.col("all")).alias("before"))
        moved = state.join(edges, "source", "left")
        low = F.when(F.col("edge").isNotNull(), F.shiftleft("edge", shift)).otherwise(F.col("low") + F.lit(1 << (shift + STEP_BITS)))
        state = checkpoint(moved.select("source", (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"), low.alias("low")))
    return state.select("source", F.col("low").alias("threshold"), "left")


def plan(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets with threshold and short: no bucket of the source's histogram uses up its budget,
    so all its texts, repeated max_repeats times, stay below the need."""
    met = budgets.join(thresholds(sized, budgets), "source", "left")
    full = (F.coalesce("threshold", F.lit(0)) >= F.lit(1 << BITS)) & (F.col("left") > 0)
    admits = F.col("max_repeats") > 0
    # a target without a name has no documents, as one without copies
    short = F.when(admits & F.col("source").isNotNull(), full).otherwise(F.col("need") > 0)
    return checkpoint(met.withColumns({"threshold": F.when(admits, F.coalesce("threshold", F.lit(0))).otherwise(F.lit(0)), "short": short}).drop("left"))


def mix(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document enters the mixture, at least once."""
    drawn = join_checked(sized.where("source is not null"), planned.select("source", "repeats", "threshold").dropDuplicates(["source"]), ["source"], "doc_id")
    copies = F.col("repeats") + (F.col("hash") < F.col("threshold")).cast("int")
    return drawn.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def reached(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target: tokens and documents drawn, the shares these are of the mixture as drawn and
    of its intended size (short sources leave the former larger for the others), shortness."""
    drawn = mix(sized, planned).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most_copies"))
    total = F.sum("tokens").over(Window.partitionBy())  # over one row per target
    joined = planned.join(drawn, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "docs", "most_copies")})
    return joined.withColumns({"share": F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), "share_of_size": F.coalesce(F.try_divide(F.col("tokens") * F.col("target_share"), F.col("need")), F.lit(0.0))}).select("target", "target_share", "share", "share_of_size", "tokens", "docs", "most_copies", "max_repeats", "short")
