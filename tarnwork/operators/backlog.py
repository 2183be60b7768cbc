"""Reference backlog, personal knowledge with supersession, context and milestones, health flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def discover_refs(commit_events: DataFrame, known: DataFrame) -> DataFrame:
    """New (ref_number, source) that commits refer to and known(ref_number) lacks; the earliest commit is the source."""
    refs = commit_events.where("pr_ref is not null").groupBy(F.col("pr_ref").alias("ref_number")).agg(F.min(F.struct("seq", "sha")).alias("x"))
    return refs.select("ref_number", F.col("x.sha").alias("source")).join(known.select("ref_number").distinct(), "ref_number", "left_anti")


def pending_refs(refs: DataFrame, limit: int = 50) -> DataFrame:
    """Neither resolved nor failed, newest first."""
    return refs.where("resolved is null and error is null").orderBy(F.desc("discovered"), "repo", "ref_number").limit(limit)


def backlog_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolved").isNotNull()).alias("resolved"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("resolved").isNull() & F.col("error").isNull()).alias("pending"))


def resolve(refs: DataFrame, outcome: DataFrame) -> DataFrame:
    """Apply outcomes (repo, ref_number, resolved, error) to the backlog; a later outcome wins over none."""
    o = outcome.select("repo", "ref_number", F.col("resolved").alias("_r"), F.col("error").alias("_e"))
    return refs.join(o, ["repo", "ref_number"], "left").withColumns({"resolved": F.coalesce("_r", "resolved"), "error": F.when(F.col("_r").isNotNull(), F.lit(None)).otherwise(F.coalesce("_e", "error"))}).drop("_r", "_e")


def supersede(events: DataFrame) -> DataFrame:
    """Knowledge events with superseded_by: the last event that supersedes each."""
    by = events.where("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.max(F.struct("timestamp", "id")).alias("x")).select("id", F.col("x.id").alias("superseded_by"))
    return events.join(by, "id", "left")


def knowledge(events: DataFrame, domains: list[str] | None = None, include_superseded: bool = False, limit: int = 20) -> DataFrame:
    """Newest knowledge first, of any of the domains."""
    rows = supersede(events)
    if not include_superseded:
        rows = rows.where("superseded_by is null")
    if domains:
        rows = rows.where(F.arrays_overlap("domains", F.array(*(F.lit(x) for x in domains))))
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def context(patterns: DataFrame, topic: str | None = None) -> DataFrame:
    """Patterns of the layers core and surface, of a topic named in id or title."""
    rows = patterns.where(F.lower("layer").isin("core", "surface"))
    if topic:
        t = F.lit(topic.lower())
        rows = rows.where(F.contains(F.lower(F.coalesce("id", F.lit(""))), t) | F.contains(F.lower(F.coalesce("title", F.lit(""))), t))
    return rows


def next_milestone(milestones: DataFrame) -> DataFrame:
    """Per spec: the least pending version above its current one, compared as text."""
    return milestones.where((F.col("status") == "pending") & (F.col("version") > F.col("current"))).groupBy("spec_id").agg(F.min("version").alias("next_version"))


def latest_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)
