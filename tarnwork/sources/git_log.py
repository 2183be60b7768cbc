"""Text logs of a version control system: commits with numstat, tags, tracked files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import change_type

_HEADER = r"^([0-9a-f]{40})\|(.*)\|([^|]*)\|([^|]*)\|(\d{4}-\d{2}-\d{2}T[^|]*)$"
_NUMSTAT = r"^(\d+|-)\t(\d+|-)\t(.+)$"


def _owned(spark: SparkSession, path: str) -> DataFrame:
    """(line, head, sha): every line with the commit it belongs to.

    Files are read in splits, as any text. Lines are numbered within their split; the last
    header of each split is carried on to the next ones of its file, of which there are as many
    as the file has splits.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("line"))
    head = F.regexp_extract("line", _HEADER, 1)
    lines = text.withColumn("head", F.when(head != "", head))
    last = lines.where("head is not null").groupBy("file", "block").agg(F.max_by("head", "n").alias("last"))
    # a split without any header passes on what it was given
    splits = lines.select("file", "block").distinct().join(last, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("own", F.last("head", ignorenulls=True).over(within)).join(carried, ["file", "block"]).select("line", F.coalesce("head", F.lit("")).alias("head"), F.coalesce("own", "carried").alias("sha"))


def read_git_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits(sha, message, author_name, author_email, timestamp) and commit_files(sha,
    file_path, change_type, lines_added, lines_removed) of logs written with
    `--pretty=%H|%s|%an|%ae|%aI --numstat`; binary files have NULL counts."""
    owned = _owned(spark, path)
    part = lambda i: F.regexp_extract("line", _HEADER, i)
    commits = owned.where("head != ''").select("sha", part(2).alias("message"), part(3).alias("author_name"), part(4).alias("author_email"), part(5).alias("timestamp")).dropDuplicates(["sha"])
    num = lambda i: F.regexp_extract("line", _NUMSTAT, i)
    files = owned.where((F.col("head") == "") & F.col("sha").isNotNull() & F.col("line").rlike(_NUMSTAT))
    added, removed = num(1).try_cast("int"), num(2).try_cast("int")
    return commits, files.select("sha", num(3).alias("file_path"), change_type(added, removed).alias("change_type"), added.alias("lines_added"), removed.alias("lines_removed")).distinct()


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tags from lines `name|sha|date|tagger|subject`; the subject may hold bars."""
    parts = F.split("value", r"\|", 5)
    return spark.read.text(path).where(F.size(parts) == 5).select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("tag_name", "sha", "tag_date", "tagger_name", "message"))))


def read_tracked_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value != ''").select(F.col("value").alias("file_path"), F.lit("tracked").alias("status"))
