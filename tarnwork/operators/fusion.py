"""Rank fusion of several sources with provenance, and what surrounds it.

Source lists are rows (query_id, source, doc_id, score); every operator takes a batch of
queries. Ties are always broken by doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import intent_weight

RRF_K = 60


def ranked(lists: DataFrame, *also_by: str) -> DataFrame:
    """Add the rank (from 1) of every row within its query and source (and also_by)."""
    order = Window.partitionBy("query_id", "source", *also_by).orderBy(F.desc("score"), "doc_id")
    return lists.withColumn("rank", F.row_number().over(order).cast("bigint"))


def rrf(lists: DataFrame, limit: int = 10, weight: Column | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, fused_score, rank, sources, contributions): sum of weight / (k + rank).

    lists must have a rank. contributions maps a source to its best rank and raw score.
    """
    w = F.lit(1.0) if weight is None else weight
    part = w / (F.lit(float(k)) + F.col("rank"))
    best = lists.withColumn("part", part).groupBy("query_id", "doc_id", "source").agg(F.sum("part").alias("part"), F.min(F.struct("rank", "score")).alias("best"))
    fused = best.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("fused_score"), F.array_sort(F.collect_set("source")).alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "best"))).alias("contributions"))
    top = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "doc_id")).cast("bigint"))
    return top.where(F.col("rank") <= limit)


def rrf_by_intent(lists: DataFrame, intents: DataFrame, limit: int = 10) -> DataFrame:
    """rrf with the weights of each query's intent; intents: (query_id, intent), one row a query."""
    return rrf(lists.join(intents, "query_id"), limit, intent_weight(F.col("intent"), F.col("source")))


def union_lists(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of several sources' (query_id, doc_id, score)."""
    return reduce(DataFrame.unionByName, [df.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("score").cast("double").alias("score")).withColumn("source", F.lit(name)) for name, df in parts.items()])


def engine(sources: dict[str, DataFrame | None], intents: DataFrame | None = None, limit: int = 10, fetch_multiplier: int = 2, only: list[str] | None = None) -> DataFrame:
    """Fuse the sources that are available and wanted, limit * fetch_multiplier rows of each."""
    usable = {name: df for name, df in sources.items() if df is not None and (only is None or name in only)}
    if not usable:
        raise ValueError("no source is available")
    lists = ranked(union_lists(usable)).where(F.col("rank") <= limit * fetch_multiplier)
    return rrf(lists, limit) if intents is None else rrf_by_intent(lists, intents, limit)


def federated(lists: DataFrame, limit: int = 10, repo: str | None = None) -> DataFrame:
    """Unweighted fusion of all repositories' lists (or one's); doc ids are prefixed by [repo].

    lists: (query_id, repo, source, doc_id, score); every (repo, source) is a list of its own.
    """
    kept = lists if repo is None else lists.where(F.col("repo") == repo)
    per = ranked(kept, "repo").withColumns({"doc_id": F.concat(F.lit("["), "repo", F.lit("] "), "doc_id"), "source": F.concat_ws(":", "repo", "source")})
    return rrf(per, limit)


def merge_belief_lists(vector: DataFrame, text: DataFrame, vector_weight: float = 0.7, text_weight: float = 0.3, limit: int = 10) -> DataFrame:
    """Full outer merge: 0.7 of the vector score and 0.3 of the text score over its maximum; one source alone keeps its own."""
    v = vector.where("score > 0").select("query_id", "doc_id", F.col("score").alias("v"))
    top = text.groupBy("query_id").agg(F.max("score").alias("m"))
    t = text.join(top, "query_id").select("query_id", "doc_id", F.when(F.col("m") > 0, F.col("score") / F.col("m")).otherwise(0.0).alias("t"))
    both = v.join(t, ["query_id", "doc_id"], "full")
    score = F.when(F.col("t").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("t")).otherwise(vector_weight * F.col("v") + text_weight * F.col("t"))
    scored = both.withColumn("score", F.round(score, 6))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("bigint"))
    return out.where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")


def expand_commits(hits: DataFrame, commit_files: DataFrame, most: int = 15, damping: float = 0.9) -> DataFrame:
    """Hits of commits followed by their files at score * damping, after all originals.

    hits: (query_id, doc_id, score, rank) with sha as doc_id; files are ranked by their
    commit's rank and path.
    """
    files = hits.join(commit_files.select(F.col("sha").alias("doc_id"), "file_path").distinct(), "doc_id")
    few = files.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("file_path"))).where(F.col("n") <= most)
    derived = few.select("query_id", F.col("file_path").alias("doc_id"), F.round(F.col("score") * damping, 6).alias("score"), F.lit(1).alias("derived"), "rank")
    originals = hits.select("query_id", "doc_id", "score", F.lit(0).alias("derived"), "rank")
    order = Window.partitionBy("query_id").orderBy("derived", "rank", "doc_id")
    return originals.unionByName(derived).withColumn("place", F.row_number().over(order).cast("bigint")).select("query_id", "doc_id", "score", F.col("derived").cast("bigint").alias("derived"), "place")


def annotate(hits: DataFrame, signals: DataFrame) -> DataFrame:
    """Structural annotations of results by their file, `./` and symbol part aside; NULL where unknown."""
    path = F.regexp_replace(F.split_part(F.col("doc_id"), F.lit("::"), F.lit(1)), r"^(\./)+", "")
    sig = signals.select(F.regexp_replace("path", r"^(\./)+", "").alias("_p"), "importer_count", "activity_level", "is_entry_point", "is_test_file").dropDuplicates(["_p"])
    return hits.withColumn("_p", path).join(sig, "_p", "left").drop("_p")


def why(fused: DataFrame, doc_id: str) -> DataFrame:
    """Rank and contributions of one document in each query's list."""
    return fused.where(F.col("doc_id") == doc_id).select("query_id", "rank", "fused_score", F.explode("contributions").alias("source", "part")).select("query_id", "rank", "fused_score", "source", F.col("part.rank").alias("source_rank"), F.col("part.score").alias("raw_score"))


def belief_impact(hits: DataFrame, reach: DataFrame, most: int = 3) -> DataFrame:
    """The `most` beliefs that reach each hit's file furthest; hits: (doc_id)."""
    met = hits.select("doc_id").distinct().join(reach, F.split_part(F.col("doc_id"), F.lit("::"), F.lit(1)) == F.col("file_path"))
    rankd = met.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("reach_score"), "belief_id")))
    return rankd.where(F.col("rn") <= most).select("doc_id", "belief_id", "reach_score", F.col("rn").cast("bigint").alias("rn"))


def expanded(query: Column, terms: Column) -> Column:
    """A query with further terms behind it."""
    return F.when(F.size(terms) > 0, F.concat_ws(" ", query, F.array_join(terms, " "))).otherwise(query)


def enrich(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Content of hits of any kind by (content_type, id), one equi-join over a tagged union."""
    return hits.join(documents.select("content_type", F.col("id").alias("doc_id"), "content"), ["content_type", "doc_id"], "left")


def family_documents(log: DataFrame, functions: DataFrame, patterns: DataFrame, commits: DataFrame, beliefs: DataFrame, co_changes: DataFrame, calls: DataFrame, most: int = 200) -> DataFrame:
    """(content_type, id, source_id, content) of everything a search may find, by family.

    Families: forge (events by seq, with the first `most` characters of their body), belief (with
    its uses and checked evidence), commit, pattern, code (functions), event (other events of
    the log), temporal (files, with how many others they change with) and dependency (functions,
    with how many they call). log: (seq, event_type, source_id, payload).
    """
    get = lambda p: F.coalesce(F.get_json_object("payload", p), F.lit(""))
    kind = F.when(F.col("event_type") == "forge.pr", "PR").otherwise("Issue")
    body = F.substring(get("$.body"), 1, most)
    headed = F.concat(kind, F.lit(" #"), "source_id", F.lit(": "), get("$.title"), F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(""))
    forge = log.where(F.col("event_type").isin("forge.issue", "forge.pr")).select(F.lit("forge").alias("content_type"), F.col("seq").cast("string").alias("id"), F.concat(F.lower(kind), F.lit("#"), "source_id").alias("source_id"), headed.alias("content"))
    other = log.where("event_type not like 'forge.%' and event_type not like 'code.%'").select(F.lit("event").alias("content_type"), F.col("seq").cast("string").alias("id"), "source_id", F.coalesce(F.get_json_object("payload", "$.content"), F.get_json_object("payload", "$.message"), F.lit("")).alias("content"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    told = F.concat(F.coalesce("statement", F.lit("")), F.lit(" (use: "), number("cited_by_beliefs"), F.lit("+"), number("cited_by_sessions"), F.lit(", truth: "), number("evidence_count"), F.lit("/"), number("evidence_verified"), F.lit(")"))
    belief = beliefs.select(F.lit("belief").alias("content_type"), "id", F.col("id").alias("source_id"), told.alias("content"))
    commit = commits.select(F.lit("commit").alias("content_type"), F.col("sha").alias("id"), F.substring("sha", 1, 7).alias("source_id"), F.col("message").alias("content"))
    pattern = patterns.select(F.lit("pattern").alias("content_type"), "id", F.col("file_path").alias("source_id"), F.concat_ws(" — ", "title", "purpose").alias("content"))
    named = F.concat("file", F.lit("::"), "name")
    code = functions.groupBy(named.alias("id")).agg(F.max("return_type").alias("ret")).select(F.lit("code").alias("content_type"), "id", F.col("id").alias("source_id"), F.concat(F.col("id"), F.coalesce(F.concat(F.lit(" -> "), "ret"), F.lit(""))).alias("content"))
    both = co_changes.select(F.col("file_a").alias("id"), F.col("file_b").alias("with")).unionByName(co_changes.select(F.col("file_b").alias("id"), F.col("file_a").alias("with")))
    temporal = both.where("id is not null").groupBy("id").agg(F.count_distinct("with").alias("n")).select(F.lit("temporal").alias("content_type"), "id", F.col("id").alias("source_id"), F.concat(F.lit("changes with "), F.col("n").cast("string"), F.lit(" files")).alias("content"))
    dependency = calls.groupBy(F.col("caller").alias("id")).agg(F.count_distinct("callee").alias("n")).select(F.lit("dependency").alias("content_type"), "id", F.col("id").alias("source_id"), F.concat(F.lit("calls "), F.col("n").cast("string"), F.lit(" functions")).alias("content"))
    return reduce(DataFrame.unionByName, [forge, other, belief, commit, pattern, code, temporal, dependency])
