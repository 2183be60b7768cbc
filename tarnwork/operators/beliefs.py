"""Belief metrics: audit flags, citations, grounding through commits to files and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import belief_keywords, is_source_code

#: Columns to sort an audit by, largest first.
SORTS = {
    "use": "total_use",
    "truth": "evidence_verified",
    "weak": "n_flags",
    "grounding": "n_files",
}


def health_flags(n_files: Column) -> Column:
    """Flags of a belief in a fixed order; n_files: files it reaches."""
    # Names and order of the flags.
    return F.array_compact(
        F.array(
            F.when(F.col("evidence_count") == 0, "no-evidence"),
            F.when((F.col("evidence_verified") == 0) & (F.col("evidence_count") > 0), "unverified"),
            F.when(F.col("cited_by_beliefs") + F.col("cited_by_sessions") == 0, "unused"),
            F.when(F.col("applied_in") == 0, "no-applications"),
            F.when(F.coalesce("contested", F.lit(0)) > 0, "verify-contested"),
            F.when(F.coalesce("errored", F.lit(0)) > 0, "verify-error"),
            F.when(n_files == 0, "floating"),
        )
    )


def audit(beliefs: DataFrame, reach: DataFrame, verification: DataFrame | None = None, order: str = "use", limit: int | None = None) -> DataFrame:
    """Beliefs with uses, reached files and flags; verification: (belief_id, contested, errored)."""
    files = reach.select(F.lower(F.trim("belief_id")).alias("k"), "file_path").groupBy("k").agg(F.count_distinct("file_path").alias("n_files"))
    joined = beliefs.withColumn("k", F.lower("id")).join(files, "k", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    if verification is None:
        joined = joined.withColumns({"contested": F.lit(0), "errored": F.lit(0)})
    else:
        joined = joined.join(verification.select(F.col("belief_id").alias("id"), "contested", "errored"), "id", "left")
    flags = health_flags(F.col("n_files"))
    out = joined.select("id", "status", (F.col("cited_by_beliefs") + F.col("cited_by_sessions")).cast("bigint").alias("total_use"), F.col("evidence_verified").cast("bigint").alias("evidence_verified"), F.col("n_files").cast("bigint").alias("n_files"), F.size(flags).cast("bigint").alias("n_flags"), F.array_join(flags, ",").alias("flags"))
    if limit is None:
        return out
    return out.orderBy(F.desc(SORTS[order]), "id").limit(limit)


def citations(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n_texts): texts other than its own that name each id.

    Ids are words of letters, digits and hyphens, so containment is an equi-join on the
    texts' hyphenated words; texts: (owner, text).
    """
    words = texts.select("owner", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9]+(?:-[A-Za-z0-9]+)+)"), 1))).alias("id"))
    met = words.join(ids.select("id").distinct(), "id").where(F.coalesce(F.col("owner") != F.col("id"), F.lit(True)))
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"))


def grounding(neighbours: DataFrame, commit_files: DataFrame, functions: DataFrame, least: float = 0.85) -> DataFrame:
    """(belief_id, file_path, reach_score, commit_count, function_count): belief to commit to file to function.

    neighbours: (belief_id, sha, score), the commits near each belief.
    """
    near = neighbours.where(F.col("score") >= least)
    files = near.join(commit_files.where(is_source_code(F.col("file_path"))).select("sha", "file_path").distinct(), "sha")
    reached = files.groupBy("belief_id", "file_path").agg(F.max("score").alias("reach_score"), F.count_distinct("sha").alias("commit_count"))
    counts = functions.groupBy(F.col("file").alias("file_path")).agg(F.count(F.lit(1)).alias("function_count"))
    return reached.join(counts, "file_path", "left").withColumn("function_count", F.coalesce("function_count", F.lit(0)))


def lexical_grounding(beliefs: DataFrame, grounded: DataFrame, functions: DataFrame, most: int = 5) -> DataFrame:
    """For beliefs without files: files whose functions' names hold words of the belief's id."""
    left = beliefs.join(grounded.select(F.col("belief_id").alias("id")).distinct(), "id", "left_anti")
    words = left.select(F.col("id").alias("belief_id"), F.explode(belief_keywords(F.col("id"))).alias("word"))
    named = functions.select("file", F.explode(F.array_distinct(F.split(F.lower("name"), "_"))).alias("word"))
    met = words.join(named, "word").groupBy("belief_id", F.col("file").alias("file_path")).agg(F.count_distinct("word").alias("n_words"))
    top = met.withColumn("rn", F.row_number().over(Window.partitionBy("belief_id").orderBy(F.desc("n_words"), "file_path")))
    return top.where(F.col("rn") <= most).select("belief_id", "file_path", "n_words")


def top_per_family(neighbours: DataFrame, most: int = 3) -> DataFrame:
    """The best neighbours of each belief by family (code, commit, session, ...)."""
    order = Window.partitionBy("belief_id", "family").orderBy(F.desc("score"), "doc_id")
    return neighbours.withColumn("rn", F.row_number().over(order).cast("bigint")).where(F.col("rn") <= most)


def metrics_summary(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total_use"), F.lit(0)).alias("uses"), F.count_if(F.col("n_files") > 0).alias("grounded"), F.count_if(F.col("evidence_verified") > 0).alias("verified"), F.count_if(F.col("n_flags") == 0).alias("healthy"))
