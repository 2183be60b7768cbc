"""Retrieval evaluation: reciprocal rank, recall, precision, latency, ablation, ground truth from commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import clean_commit_message
from tarnwork.plans.shaping import small


def per_query(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10), contains: bool = False) -> DataFrame:
    """(query_id, rr, recall_k...) of every query; retrieved: (query_id, doc_id, rank), relevant: (query_id, doc).

    Recall is 1 for a query without relevant documents. contains: a document matches also if
    either name contains the other.
    """
    r, g = retrieved.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "rank"), relevant.select("query_id", F.col("doc").cast("string").alias("doc")).distinct()
    match = (F.col("doc_id") == F.col("doc")) if not contains else (F.contains("doc_id", F.col("doc")) | F.contains("doc", F.col("doc_id")))
    met = r.join(g, "query_id").where(match)
    first = met.groupBy("query_id", "doc").agg(F.min("rank").alias("first"))
    stats = g.join(first, ["query_id", "doc"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("best"), *(F.count_if(F.col("first") <= k).alias(f"found_{k}") for k in ks))
    joined = queries.select("query_id").distinct().join(stats, "query_id", "left")
    recall = lambda k: F.round(F.when(F.col("n").isNull(), 1.0).otherwise(F.col(f"found_{k}") / F.col("n")), 6)
    return joined.select("query_id", F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("rr"), *(recall(k).alias(f"recall_{k}") for k in ks))


def summary(scores: DataFrame) -> DataFrame:
    """MRR, mean recalls and the quality band over queries."""
    m, r = F.avg("rr"), F.avg("recall_10")
    band = F.when((m >= 0.5) & (r >= 0.7), "good").when((m >= 0.3) & (r >= 0.5), "acceptable").otherwise("poor")
    return scores.agg(F.count(F.lit(1)).alias("n_queries"), F.round(m, 6).alias("mrr"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(r, 6).alias("recall_10"), band.alias("band"))


def repo_recall(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, repo_recall): expected repositories among the prefixes `repo:` of the results."""
    found = retrieved.where(F.contains("doc_id", F.lit(":"))).select("query_id", F.lower(F.split_part("doc_id", F.lit(":"), F.lit(1))).alias("repo")).distinct().withColumn("hit", F.lit(1))
    e = expected.select("query_id", F.lower("repo").alias("repo")).distinct().join(found, ["query_id", "repo"], "left")
    return e.groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("repo_recall"))


def nearest_rank_percentiles(df: DataFrame, value: str, percents: tuple[int, ...], *by: str, buckets: int = 4096) -> DataFrame:
    """Values at place round((n - 1) * p / 100) of the sorted values of each group.

    Places are found in a histogram of `buckets` equal widths first; only the values of the
    buckets in which a place falls are counted one by one, so no task sorts a whole group.
    """
    keys = [F.col(c) for c in by] or [F.lit(1)]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.struct(*keys).alias("_g"))
    ends = rows.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    laid = rows.join(small(ends), "_g").withColumn("_b", F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    part = Window.partitionBy("_g")
    hist = laid.groupBy("_g", "_n", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = hist.withColumn("_before", F.coalesce(F.sum("_c").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = lambda p: F.floor((F.col("_n") - 1) * p / 100.0 + 0.5)
    places = F.array(*(F.struct(F.lit(f"p{p}").alias("name"), place(p).alias("at")) for p in percents))
    wanted = upto.select("_g", "_b", "_before", "_c", F.explode(places).alias("w")).where((F.col("w.at") >= F.col("_before")) & (F.col("w.at") < F.col("_before") + F.col("_c"))).select("_g", "_b", "w.name", (F.col("w.at") - F.col("_before")).alias("_at"))
    near = laid.join(small(wanted.select("_g", "_b").distinct()), ["_g", "_b"]).groupBy("_g", "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inner = near.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = inner.join(wanted, ["_g", "_b"]).where(F.col("_upto") > F.col("_at")).groupBy("_g", "name").agg(F.min("_v").alias("_v"))
    wide = found.groupBy("_g").agg(*(F.max(F.when(F.col("name") == f"p{p}", F.col("_v"))).alias(f"p{p}") for p in percents))
    out = wide.join(ends.select("_g", F.col("_n").alias("n")), "_g")
    return out.select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", *(f"p{p}" for p in percents))


def precision_at(pairs: DataFrame, k: int) -> Column:
    """Hits among the first k over min(k, expected); columns rank, hit, expected."""
    return F.count_if((F.col("rank") <= k) & F.col("hit")) / F.greatest(F.least(F.lit(k), F.max("expected")), F.lit(1))


def score_distribution(df: DataFrame, score: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.var_pop(score), 6).alias("variance"), F.round(F.min(score), 6).alias("least"), F.round(F.max(score), 6).alias("most"))


def ablation(with_source: DataFrame, without: DataFrame, budget: float = 0.05) -> DataFrame:
    """Whether leaving a source out changes the mean rr by more than a budget; inputs as from per_query."""
    both = with_source.select("query_id", F.col("rr").alias("a")).join(without.select("query_id", F.col("rr").alias("b")), "query_id")
    diff = F.avg(F.col("a") - F.col("b"))
    return both.agg(F.round(F.avg("a"), 6).alias("mrr_with"), F.round(F.avg("b"), 6).alias("mrr_without"), F.round(diff, 6).alias("gain"), F.when(diff < -budget, "harmful").when(diff > budget, "helpful").otherwise("neutral").alias("verdict"))


def queryset_from_commits(commits: DataFrame, commit_files: DataFrame, least_len: int = 20, most_len: int = 200, least_files: int = 1, most_files: int = 10, limit: int = 50) -> DataFrame:
    """(sha, query, files): descriptive commits as queries, their files as relevant documents."""
    m = F.col("message")
    fit = (F.length(m) > least_len) & (F.length(m) < most_len) & ~m.rlike(r"(?i)^(merge|wip|fixup|squash)")
    rows = commits.where(fit).join(commit_files.select("sha", "file_path").distinct(), "sha").groupBy("sha", "message", "timestamp").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("file_path")), "|").alias("files"))
    kept = rows.where(F.col("n").between(least_files, most_files)).orderBy(F.desc_nulls_last("timestamp"), "sha").limit(limit)
    return kept.select("sha", clean_commit_message(m).alias("query"), "files")
