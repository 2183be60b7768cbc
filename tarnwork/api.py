"""One object for users: search, orientation, structure, context and reports over a set of tables.

Tables are DataFrames by name, as in the schemas of the event log's views; what is missing
only switches off the sources that need it. Every method takes a batch or one query and
returns a DataFrame; nothing runs before the caller acts on it, but for small size checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import text
from tarnwork.operators import assay, backlog, beliefs, eventlog, feedback, fts, fusion, knn
from tarnwork.operators.training import hashed_embedding

#: Results that may be asked for at once, and the default.
MOST, DEFAULT = 100, 10
#: Event-type prefixes of the content types a search may be narrowed to.
CONTENT_TYPES = {"code": "code.", "commits": "git.", "sessions": "session.", "patterns": "pattern.", "beliefs": "belief.", "forge": "forge."}

Embed = Callable[[DataFrame], DataFrame]


def hashing_embedder(df: DataFrame) -> DataFrame:
    """df(id, text) with an embedding of feature hashes; replace by a model's pandas UDF where there is one."""
    return df.withColumn("embedding", hashed_embedding(fts.tokens(F.col("text"))))


def clamp(limit: int | None) -> int:
    return max(1, min(MOST, limit or DEFAULT))


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], embed: Embed = hashing_embedder):
        self.spark, self.tables, self.embed = spark, tables, embed

    # --- search -----------------------------------------------------------------------------

    def corpus(self, content_type: str | None = None) -> DataFrame:
        """(doc_id, event_type, text): everything that can be found, of one content type if given."""
        t, parts = self.tables, []

        def add(name: str, event_type: str, doc_id, body) -> None:
            if name in t:
                parts.append(t[name].select(doc_id.cast("string").alias("doc_id"), F.lit(event_type).alias("event_type"), body.alias("text")))

        add("commits", "git.commit", F.col("sha"), text.commit_text(F.col("sha"), F.col("message"), F.col("author_name")))
        add("patterns", "pattern.doc", F.col("id"), F.concat_ws(" ", "title", "purpose", "tags"))
        add("beliefs", "belief.surface", F.col("id"), F.concat_ws(" ", "statement", "facets"))
        add("forge_issues", "forge.issue", F.concat(F.lit("#"), F.col("number").cast("string")), F.concat_ws(" ", "title", "body"))
        add("forge_prs", "forge.pr", F.concat(F.lit("#"), F.col("number").cast("string")), F.concat_ws(" ", "title", "body"))
        add("observations", "session.observation", F.col("id"), F.col("content"))
        add("function_facts", "code.function", F.concat("file", F.lit("::"), "name"), F.concat_ws(" ", "name", "file", "return_type"))
        if not parts:
            raise ValueError("no table to search")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if content_type is not None:
            out = out.where(F.col("event_type").startswith(CONTENT_TYPES[content_type]))
        return out.where("doc_id is not null and text is not null").dropDuplicates(["doc_id", "event_type"])

    def batch(self, queries: str | list[str] | DataFrame, expanded_terms: list[str] | None = None) -> DataFrame:
        """(query_id, query, intent) of one text, a list of texts, or a frame of both columns."""
        if not isinstance(queries, DataFrame):
            texts = [queries] if isinstance(queries, str) else queries
            queries = self.spark.createDataFrame([(str(i), q) for i, q in enumerate(texts)], "query_id string, query string")
        if expanded_terms:
            queries = queries.withColumn("query", fusion.expanded(F.col("query"), F.array(*(F.lit(x) for x in expanded_terms))))
        return queries.select("query_id", "query", text.intent(F.col("query")).alias("intent"))

    def lexical(self, batch: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
        asked = batch.select("query_id", text.fts_query(F.col("query")).alias("query"))
        return fts.bm25(fts.index(docs, "doc_id", "text", folded=True), fts.query_terms(asked, folded=True), limit)

    def semantic(self, batch: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
        vectors = self.embed(docs.select(F.col("doc_id").alias("id"), "text")).select(F.xxhash64("id").alias("vec_id"), F.col("id").alias("doc_id"), "embedding")
        asked = self.embed(batch.select(F.col("query_id").alias("id"), F.col("query").alias("text"))).select(F.xxhash64("id").alias("q"), F.col("id").alias("name"), "embedding")
        near = knn.knn(vectors, asked.select(F.col("q").alias("query_id"), "embedding"), limit, skip_self=False)
        return near.join(vectors.select("vec_id", "doc_id"), "vec_id").join(asked.select(F.col("q").alias("query_id"), "name"), "query_id").where("score > 0").select(F.col("name").alias("query_id"), "doc_id", "score")

    def search(self, queries, limit: int | None = None, content_type: str | None = None, min_score: float | None = None, only: list[str] | None = None, expanded_terms: list[str] | None = None, annotate: bool = True) -> DataFrame:
        """Fused results of all available sources, weighted by each query's intent.

        min_score is applied to the `limit` results, not before, as a list is cut first.
        """
        n, batch, docs = clamp(limit), self.batch(queries, expanded_terms), self.corpus(content_type)
        sources: dict[str, DataFrame | None] = {"lexical": self.lexical(batch, docs, 2 * n), "semantic": self.semantic(batch, docs, 2 * n), "temporal": None, "persona": None, "belief": None}
        if "co_changes" in self.tables and content_type in (None, "code"):
            sources["temporal"] = assay.temporal_neighbours(self.tables["co_changes"], batch, n).withColumnRenamed("file", "doc_id")
        if "beliefs" in self.tables and content_type in (None, "beliefs"):
            b = self.tables["beliefs"].where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", "statement", "facets").alias("text"))
            sources["belief"] = fusion.merge_belief_lists(self.semantic(batch, b, 2 * n), self.lexical(batch, b, 2 * n), limit=2 * n)
        if "knowledge" in self.tables and content_type is None:
            k = backlog.supersede(self.tables["knowledge"]).where("superseded_by is null").select(F.concat_ws(":", F.lit("persona"), "source", F.col("timestamp").cast("string")).alias("doc_id"), F.col("content").alias("text")).dropDuplicates(["doc_id"])
            sources["persona"] = self.semantic(batch, k, 2 * n)
        fused = fusion.engine(sources, batch.select("query_id", "intent"), n, only=only)
        if min_score is not None:
            fused = fused.where(F.col("fused_score") >= min_score)
        shown = fused.join(docs, "doc_id", "left").withColumn("snippet", text.snippet(F.col("text"), F.coalesce("event_type", F.lit("co_change")))).drop("text")
        if annotate and "module_signals" in self.tables:
            shown = fusion.annotate(shown, self.tables["module_signals"])
        return shown

    def plan(self, query: str) -> str:
        """Which single source suits a query: lexical for names and code, else semantic."""
        return "lexical" if self.spark.range(1).select(text.is_lexical_query(F.lit(query))).first()[0] else "semantic"

    def neighbours(self, doc_id: str, limit: int | None = None, content_type: str | None = None, min_score: float = 0.0) -> DataFrame:
        """Documents nearest to one document's own vector, itself left out."""
        docs = self.corpus()
        own = docs.where(F.col("doc_id") == doc_id).select(F.lit("own").alias("query_id"), F.col("text").alias("query")).limit(1)
        pool = self.corpus(content_type) if content_type else docs
        return self.semantic(own, pool.where(F.col("doc_id") != doc_id), clamp(limit)).where(F.col("score") >= min_score).orderBy(F.desc("score"), "doc_id").limit(clamp(limit))

    def why(self, query: str, doc_id: str) -> DataFrame:
        """Rank and contributions of one document among the first 50."""
        return fusion.why(self.search(query, 50, annotate=False), doc_id)

    # --- structure --------------------------------------------------------------------------

    def orient(self, prefix: str = "", limit: int | None = None) -> DataFrame:
        return assay.orient(self.tables["module_signals"], prefix, clamp(limit))

    def assay(self, kind: str, pattern: str = "", limit: int = 100) -> DataFrame:
        t = self.tables
        if kind == "inventory":
            return assay.inventory(t["index_state"], t["function_facts"], t["import_facts"], pattern or "%", limit)
        table, columns, order = {
            "functions": ("function_facts", ["name", "file"], ["file", "name"]),
            "imports": ("import_facts", ["file"], ["file", "import_path"]),
            "importers": ("import_facts", ["import_path"], ["import_path", "file"]),
            "callers": ("call_graph", ["callee"], ["caller", "file", "line_number"]),
            "callees": ("call_graph", ["caller"], ["callee", "file", "line_number"]),
        }[kind]
        return assay.search(t[table], columns, pattern, order, limit)

    def moments(self) -> DataFrame:
        return assay.moments(self.tables["commits"], self.tables["commit_files"])

    # --- log, context, reports --------------------------------------------------------------

    def _event(self, rows: DataFrame, event_type: str, query_id: str, data) -> DataFrame:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return rows.select(F.lit(0).cast("bigint").alias("seq"), F.lit(event_type).alias("event_type"), now.alias("timestamp"), F.lit(query_id).alias("source_id"), F.lit(None).cast("string").alias("source_file"), data.alias("data"))

    def log_search(self, session_id: str, query_id: str, query: str, results: DataFrame, mode: str = "find") -> DataFrame:
        """The event of a search, to be appended to the log: query, session and ranked results."""
        items = results.select(F.struct(F.col("doc_id"), F.col("fused_score").alias("score"), F.col("rank"), F.coalesce("event_type", F.lit("")).alias("event_type")).alias("r"))
        body = items.agg(F.array_sort(F.collect_list("r"), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("results"))  # at most MOST rows
        return self._event(body, "scry.query", query_id, F.to_json(F.struct(F.lit(query).alias("query"), F.lit(query_id).alias("query_id"), F.lit(mode).alias("mode"), F.lit(session_id).alias("session_id"), F.col("results"))))

    def log_use(self, session_id: str, query_id: str, doc_id: str, rank: int) -> DataFrame:
        """The event of a result that was opened or copied."""
        fields = (("query_id", query_id), ("result_used", doc_id), ("rank", rank), ("session_id", session_id))
        return self._event(self.spark.range(1), "scry.use", query_id, F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in fields))))

    def log_feedback(self, session_id: str, query_id: str, signal: str, comment: str | None = None) -> DataFrame:
        """The event of a rating of a query's results."""
        fields = (("query_id", query_id), ("signal", signal), ("comment", comment), ("session_id", session_id))
        return self._event(self.spark.range(1), "scry.feedback", query_id, F.to_json(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in fields))))

    def append(self, events: DataFrame) -> DataFrame:
        return eventlog.append(self.tables["eventlog"], events)

    def result_at(self, query_id: str, rank: int) -> DataFrame:
        return feedback.result_at(self.tables["eventlog"], query_id, rank)

    def context(self, topic: str | None = None) -> DataFrame:
        return backlog.context(self.tables["patterns"], topic)

    def belief_metrics(self, order: str = "use", limit: int = 10) -> DataFrame:
        return beliefs.audit(self.tables["beliefs"], self.tables["belief_code_reach"], order=order, limit=limit)

    def report(self) -> dict[str, DataFrame]:
        """Sections for sources.records.report."""
        t, out = self.tables, {}
        if "index_state" in t:
            out["Languages"] = t["index_state"].groupBy(text.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")).orderBy(F.desc("lines"), "language")
            out["Largest modules"] = t["index_state"].orderBy(F.desc("lines"), "path").limit(10).select("path", "lines")
        if "eventlog" in t:
            out["Events"] = t["eventlog"].groupBy(F.split_part("event_type", F.lit("."), F.lit(1)).alias("family")).agg(F.count(F.lit(1)).alias("events")).orderBy("family")
        if "forge_refs" in t:
            out["Backlog"] = backlog.backlog_counts(t["forge_refs"]).orderBy("repo")
        return out
