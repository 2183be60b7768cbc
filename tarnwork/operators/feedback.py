"""Feedback loop: which results of logged queries were committed, used or rated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.eventlog import json_items, scan, with_payload


def _fields(log: DataFrame, event_type: str, **paths: str) -> DataFrame:
    rows = with_payload(scan(log, [event_type]))
    return rows.select("seq", "timestamp", *(F.get_json_object("payload", p).alias(name) for name, p in paths.items()))


def session_queries(log: DataFrame) -> DataFrame:
    rows = _fields(log, "scry.query", session_id="$.session_id", query_id="$.query_id", query="$.query", mode="$.mode", results="$.results")
    return rows.where("session_id is not null")


def usage(log: DataFrame) -> DataFrame:
    rows = _fields(log, "scry.use", query_id="$.query_id", doc_id="$.result_used", rank="$.rank", session_id="$.session_id")
    return rows.withColumn("rank", F.col("rank").try_cast("bigint"))


def ratings(log: DataFrame) -> DataFrame:
    return _fields(log, "scry.feedback", query_id="$.query_id", signal="$.signal", comment="$.comment", session_id="$.session_id")


def commit_files(log: DataFrame, one_row_per_commit: bool = False) -> DataFrame:
    """(session_id, sha, file_path, change_type) of each commit's last event that has a session.

    one_row_per_commit numbers rows after the files are laid out, so that one file of every
    commit survives (the least path of the last event).
    """
    rows = _fields(log, "git.commit", session_id="$.session_id", sha="$.sha", files="$.files").where("session_id is not null and sha is not null")
    item = F.col("item")
    if not one_row_per_commit:
        last = rows.groupBy("sha").agg(F.max(F.struct("seq", "session_id", "files")).alias("r"))
        flat = last.select("sha", "r.session_id", F.explode(json_items(F.col("r.files"))).alias("item"))
        flat = flat.select("session_id", "sha", F.get_json_object(item, "$.path").alias("file_path"), F.coalesce(F.get_json_object(item, "$.change_type"), F.get_json_object(item, "$.changeType")).alias("change_type"))
        return flat.where("file_path is not null").distinct()
    flat = rows.select("seq", "sha", "session_id", F.explode(json_items(F.col("files"))).alias("item"))
    flat = flat.select("seq", "sha", "session_id", F.get_json_object(item, "$.path").alias("file_path"), F.coalesce(F.get_json_object(item, "$.change_type"), F.get_json_object(item, "$.changeType")).alias("change_type")).where("file_path is not null")
    order = Window.partitionBy("sha").orderBy(F.desc("seq"), F.asc("file_path"), F.asc("change_type"))
    return flat.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("session_id", "sha", "file_path", "change_type")


def results(log: DataFrame) -> DataFrame:
    """One row per logged result."""
    flat = session_queries(log).select("seq", "session_id", "query_id", "query", "mode", F.explode(json_items(F.col("results"))).alias("item"))
    item = F.col("item")
    return flat.select(
        "seq", "session_id", "query_id", "query", "mode", F.get_json_object(item, "$.doc_id").alias("doc_id"), F.get_json_object(item, "$.rank").try_cast("bigint").alias("rank"), F.get_json_object(item, "$.score").try_cast("double").alias("score")
    ).where("doc_id is not null")


def query_hits(log: DataFrame) -> DataFrame:
    """results(log) with is_hit: a file committed in the session contains the result's id."""
    found = results(log)
    files = commit_files(log).select("session_id", "file_path").distinct()
    # an equi-join on the session; the containment is its residual
    hits = found.select("session_id", "doc_id").distinct().join(files, "session_id").where(F.contains("file_path", "doc_id")).select("session_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return found.join(hits, ["session_id", "doc_id"], "left").withColumn("is_hit", F.coalesce("hit", F.lit(0)).cast("bigint")).drop("hit")


def query_analysis(log: DataFrame) -> DataFrame:
    """Per logged query: number and ranks of uses, the first rating."""
    queries = _fields(log, "scry.query", query_id="$.query_id", session_id="$.session_id", query="$.query", mode="$.mode")
    used = usage(log).where("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("use_count"), F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r.cast("string")), ",").alias("used_ranks"))
    rated = ratings(log).where("query_id is not null").groupBy("query_id").agg(F.min(F.struct("seq", "signal")).alias("f")).select("query_id", F.col("f.signal").alias("feedback_signal"))
    joined = queries.join(used, "query_id", "left").join(rated, "query_id", "left")
    return joined.select("seq", "session_id", "query_id", "query", "mode", F.coalesce("use_count", F.lit(0)).alias("use_count"), F.coalesce("used_ranks", F.lit("")).alias("used_ranks"), "feedback_signal")


def precision(hits: DataFrame, *by: str) -> DataFrame:
    out = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_results"), F.sum("is_hit").alias("n_hits"))
    return out.withColumn("hit_rate", F.round(F.col("n_hits") / F.col("n_results"), 6))


def result_at(log: DataFrame, query_id: str, rank: int) -> DataFrame:
    """The rank-th result of a logged query, from its last event."""
    return results(log).where((F.col("query_id") == query_id) & (F.col("rank") == rank)).orderBy(F.desc("seq"), "doc_id").limit(1)
