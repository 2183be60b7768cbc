"""Markdown sources: sessions, patterns and beliefs with front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.text import document_title


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text) of all .md files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.regexp_replace("value", "\r\n", "\n").alias("text"))


def front_matter(text: Column, field: str) -> Column:
    """A field of the YAML front matter, else of a legacy line `**Field**: value`; NULL if neither."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    value = F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{field}:[ \t]*(.*)$", 1), r"""^["']|["']\s*$""", ""))
    legacy = F.trim(F.regexp_extract(text, rf"(?mi)^\*\*{field}\*\*:[ \t]*(.*)$", 1))
    return F.when(value != "", value).when(legacy != "", legacy)


def section(text: Column, title: str) -> Column:
    """Body of the section `## title`, up to the next one."""
    return F.trim(F.regexp_extract(text, rf"(?ms)^## {title}[^\n]*\n(.*?)(?=^## |\z)", 1))


def checkboxes(text: Column) -> Column:
    """Array of (done, content) of `- [x] content` lines."""
    marks, items = (F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*] \[([ xX])\] (.+)$"), i) for i in (1, 2))
    return F.zip_with(marks, items, lambda m, c: F.struct((F.lower(m) == "x").alias("done"), F.trim(c).alias("content")))


def bullets(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[-*] (.+)$"), 1), lambda x: F.trim(x))


def sessions(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    name = F.regexp_extract("file_path", r"([^/]+)\.md$", 1)
    return docs.select(
        F.coalesce(front_matter(t, "id"), name).alias("id"), F.coalesce(front_matter(t, "title"), document_title(t)).alias("title"), front_matter(t, "(?:started_at|created|started)").alias("started_at"), front_matter(t, "(?:ended_at|ended)").alias("ended_at"),
        front_matter(t, "(?:branch|git_branch)").alias("branch"), front_matter(t, "classification").alias("classification"), front_matter(t, "(?:files_changed|files changed)").try_cast("int").alias("files_changed"), front_matter(t, "(?:commits_made|commits)").try_cast("int").alias("commits_made"), "file_path",
    )


def session_goals(docs: DataFrame) -> DataFrame:
    """(session_id, pos, content, completed) of the check boxes of each session."""
    rows = docs.select(F.coalesce(front_matter(F.col("text"), "id"), F.regexp_extract("file_path", r"([^/]+)\.md$", 1)).alias("session_id"), F.posexplode(checkboxes(F.col("text"))).alias("pos", "g"))
    return rows.select("session_id", "pos", F.col("g.content").alias("content"), F.col("g.done").alias("completed"))


def observations(docs: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(session_id, observation_type, pos, content): bullets of the sections of each kind."""
    kinds = kinds or {"decision": "Decisions?", "pattern": "Patterns?", "work": "Work(?: Done)?", "context": "Context"}
    out = None
    for kind, title in kinds.items():
        part = docs.select(F.coalesce(front_matter(F.col("text"), "id"), F.regexp_extract("file_path", r"([^/]+)\.md$", 1)).alias("session_id"), F.lit(kind).alias("observation_type"), F.posexplode(bullets(section(F.col("text"), title))).alias("pos", "content"))
        out = part if out is None else out.unionByName(part)
    return out


def patterns(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    purpose = F.regexp_extract(t, r"(?m)^\*\*Purpose\*\*:[ \t]*(.+)$", 1)
    return docs.select(
        F.coalesce(front_matter(t, "id"), F.regexp_extract("file_path", r"([^/]+)\.md$", 1)).alias("id"), F.coalesce(front_matter(t, "title"), document_title(t)).alias("title"), front_matter(t, "layer").alias("layer"), front_matter(t, "status").alias("status"),
        front_matter(t, "created").alias("created"), front_matter(t, "tags").alias("tags"), front_matter(t, "references").alias("refs"), F.when(purpose != "", purpose).alias("purpose"), "file_path", front_matter(t, "current_milestone").alias("current_milestone"),
    )


def belief_docs(docs: DataFrame) -> DataFrame:
    """Beliefs with the counts of their evidence, applications and attacks."""
    t = F.col("text")
    body = F.regexp_replace(t, r"(?s)\A---\n.*?\n---\n", "")
    statement = F.trim(F.regexp_extract(body, r"(?ms)^# [^\n]+\n\s*\n?([^#\n][^\n]*)", 1))
    evidence, applied, attacked = bullets(section(t, "Evidence")), bullets(section(t, "Applied-In")), bullets(section(t, "Attacked-By"))
    return docs.select(
        front_matter(t, "id").alias("id"), F.when(statement != "", statement).alias("statement"), front_matter(t, "persona").alias("persona"), front_matter(t, "facets").alias("facets"), front_matter(t, "confidence").try_cast("double").alias("confidence"), front_matter(t, "entrenchment").alias("entrenchment"),
        front_matter(t, "status").alias("status"), front_matter(t, "extracted").alias("extracted"), front_matter(t, "revised").alias("revised"), F.size(evidence).alias("evidence_count"), F.size(applied).alias("applied_in"), F.size(attacked).alias("attacked_by"),
        F.size(F.filter(attacked, lambda x: F.lower(x).contains("status: defeated"))).alias("defeated_attacks"), evidence.alias("evidence"), "file_path",
    )


def verified_evidence(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, evidence_verified, evidence_external): evidence that links to a known document or
    session (known: id), and evidence that names an outside source."""
    rows = belief_docs(docs).select("id", F.posexplode("evidence").alias("pos", "e"))
    links = rows.select("id", "pos", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("e", F.lit(r"\[\[([^\]|#]+)"), 1), F.regexp_extract_all("e", F.lit(r"\b(\d{8}-\d{6})\b"), 1)))).alias("link"))
    ok = links.withColumn("link", F.regexp_replace("link", r"^session-", "")).join(known.select(F.col("id").alias("link")).distinct(), "link", "left_semi").select("id", "pos").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("evidence_verified"))
    outside = rows.groupBy("id").agg(F.count_if(F.lower("e").rlike(r"\b(paper|blog|rfc|doi|helland)\b")).alias("evidence_external"))
    return outside.join(ok, "id", "left").select("id", F.coalesce("evidence_verified", F.lit(0)).alias("evidence_verified"), "evidence_external")
