"""JSON sources and sinks: personal events, query sets, forge records, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERSONA = "id string, event_type string, timestamp bigint, source string, content string, domains array<string>, working_project string, supersedes string"
QUERY_SET = "name string, description string, queries array<struct<id:string,query:string,relevant_docs:array<string>,relevant_commits:array<string>,relevant:array<string>,expected_repos:array<string>>>"
FORGE = "number bigint, title string, body string, state string, labels array<struct<name:string>>, author struct<login:string>, createdAt string, updatedAt string, mergedAt string, url string"


def read_persona(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """Daily JSON lines of personal events; after: an id up to which events are known."""
    df = spark.read.schema(PERSONA).json(path).where("id is not null")
    if after is None:
        return df
    seen = df.where(F.col("id") == after).select("timestamp").limit(1).first()
    return df if seen is None else df.where((F.col("timestamp") > seen[0]) | ((F.col("timestamp") == seen[0]) & (F.col("id") > after)))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    q = spark.read.schema(QUERY_SET).option("multiLine", "true").json(path).select(F.explode("queries").alias("q")).select("q.*").withColumnRenamed("id", "query_id")
    lists = ("relevant_docs", "relevant_commits", "relevant", "expected_repos")
    return q.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def read_forge(spark: SparkSession, path: str) -> DataFrame:
    """Issues or pull requests as an issue tracker's command line writes them."""
    df = spark.read.schema(FORGE).option("multiLine", "true").json(path).where("number is not null")
    return df.select("number", "title", "body", F.lower("state").alias("state"), F.to_json(F.transform("labels", lambda x: x["name"])).alias("labels"), F.col("author.login").alias("author"), F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"), F.col("mergedAt").alias("merged_at"), "url")


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join([head, *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows)])


def report(sections: dict[str, DataFrame]) -> str:
    return "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in sections.items())
