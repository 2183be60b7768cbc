"""An issue tracker as a Spark data source: spark.read.format("forge").option("path", folder).

The folder holds one JSON file per page of issues or pull requests, as a tracker's command
line or API writes them; every file is a partition, so pages are read side by side. Options:
kind (issue or pr), since (an ISO time; records not updated since are left out).
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "number bigint, kind string, title string, body string, state string, labels string, author string, created_at string, updated_at string, merged_at string, url string"


class ForgeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "forge"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ForgeReader:
        return ForgeReader(self.options)


class ForgeReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.kind, self.since = options.get("path"), options.get("kind", "issue"), options.get("since")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: InputPartition):
        if partition is None:
            return
        pages = json.loads(Path(partition.value).read_text())
        for r in pages if isinstance(pages, list) else [pages]:
            pick = lambda *names: next((r[n] for n in names if r.get(n) is not None), None)  # noqa: B023, E731
            updated = pick("updatedAt", "updated_at")
            if r.get("number") is None or (self.since and updated and updated < self.since):
                continue
            labels = [x["name"] if isinstance(x, dict) else x for x in r.get("labels") or []]
            author = r.get("author") or r.get("user")
            yield (r["number"], self.kind, r.get("title"), r.get("body"), (r.get("state") or "").lower(), json.dumps(labels), author.get("login") if isinstance(author, dict) else author, pick("createdAt", "created_at"), updated, pick("mergedAt", "merged_at"), pick("url", "html_url"))


def register(spark) -> None:
    spark.dataSource.register(ForgeSource)


_PERSON = "struct<login:string>"
_PAGE = f"array<struct<number:bigint,title:string,body:string,state:string,labels:array<string>,author:{_PERSON},user:{_PERSON},createdAt:string,created_at:string,updatedAt:string,updated_at:string,mergedAt:string,merged_at:string,url:string,html_url:string>>"


def read_forge(spark: SparkSession, path: str, kind: str = "issue", since: str | None = None) -> DataFrame:
    """The same rows from pages on any file system that Spark reads; a page is one task's row."""
    return parse_pages(spark.read.text(path, wholetext=True, pathGlobFilter="*.json"), kind, since)


def parse_pages(pages: DataFrame, kind: str = "issue", since: str | None = None) -> DataFrame:
    """Rows of pages(value), each the JSON of a record or of an array of them."""
    text = pages.select(F.trim("value").alias("v"))
    pages = text.select(F.explode(F.from_json(F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.concat(F.lit("["), "v", F.lit("]"))), _PAGE)).alias("r")).where("r.number is not null")
    name = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)
    labels = F.to_json(F.array_compact(F.transform(F.coalesce("r.labels", F.array().cast("array<string>")), name)))
    rows = pages.select(
        "r.number", F.lit(kind).alias("kind"), "r.title", "r.body", F.lower(F.coalesce("r.state", F.lit(""))).alias("state"), labels.alias("labels"), F.coalesce("r.author.login", "r.user.login").alias("author"), F.coalesce("r.createdAt", "r.created_at").alias("created_at"),
        F.coalesce("r.updatedAt", "r.updated_at").alias("updated_at"), F.coalesce("r.mergedAt", "r.merged_at").alias("merged_at"), F.coalesce("r.url", "r.html_url").alias("url"),
    )
    return rows if since is None else rows.where(F.col("updated_at").isNull() | (F.col("updated_at") >= since))


def counts(records: DataFrame) -> DataFrame:
    """(kind, n, most): how many issues and pull requests there are, and their greatest number."""
    return records.groupBy("kind").agg(F.count_distinct("number").alias("n"), F.max("number").alias("most"))


def one(records: DataFrame, kind: str, number: int) -> DataFrame:
    """The issue or pull request of a number as it was updated last."""
    return records.where((F.col("kind") == kind) & (F.col("number") == number)).orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("title")).limit(1)
