"""Full-text search: tokens, BM25 top-k for a batch of queries, phrases, snippets.

Ranking: k1 = 1.2, b = 0.75, idf = ln((N - n + 0.5) / (n + 0.5)) but at least 1e-6, document
length and average over all indexed columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.functions.porter import stem_column
from tarnwork.operators import blocks
from tarnwork.plans.shaping import BROADCAST_ROWS, join_counted, small, written

K1, B, LEAST_IDF = blocks.K1, blocks.B, blocks.LEAST_IDF
#: A batch of more words than this would pair too many queries with too many documents.
MANY_WORDS = 5_000
#: Buckets of a written index, and words of a batch that are pushed down to its files.
BUCKETS, PUSHED_WORDS = 64, 2_000


def tokens(*columns: Column, folded: bool = False) -> Column:
    """Lower-case runs of letters and digits of all columns; ASCII ones only unless folded.

    folded keeps letters of all scripts and takes off the diacritics of Latin ones.
    """
    joined = F.lower(F.concat_ws(" ", *columns))
    if not folded:
        return F.regexp_extract_all(joined, F.lit("([a-z0-9]+)"), 1)
    plain = F.translate(joined, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), 1)


def index(docs: DataFrame, doc_id: str, *columns: str, folded: bool = False) -> DataFrame:
    """(doc_id, tokens, len) of every document; narrow."""
    toks = tokens(*(F.col(c) for c in columns), folded=folded)
    return docs.select(F.col(doc_id).alias("doc_id"), toks.alias("tokens")).withColumn("len", F.size("tokens"))


def query_terms(queries: DataFrame, folded: bool = False) -> DataFrame:
    """(query_id, term) of queries(query_id, query); the word OR between terms is no term."""
    text = F.regexp_replace("query", r"\bOR\b", " ")
    return queries.select("query_id", F.explode(F.array_distinct(tokens(text, folded=folded))).alias("term"))


def stemmed_terms(idx: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, stem, term): terms of the vocabulary with the stem of a query term; only
    distinct words are stemmed, never the postings."""
    vocabulary = idx.select(F.explode("tokens").alias("term")).distinct().withColumn("stem", stem_column(F.col("term")))
    wanted = terms.select("query_id", stem_column(F.col("term")).alias("stem")).distinct()
    return vocabulary.join(small(wanted), "stem").select("query_id", "stem", "term")


#: Stands for a document itself among its words; no text holds it as a word.
_ITSELF = "\u0000"


def bm25(idx: DataFrame, terms: DataFrame, limit: int = 10, groups: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query, ties by doc_id.

    groups: (doc_id, ...), one row a document; its other columns are added and the best are
    ranked and cut in each of their groups.

    terms: (query_id, term) or (query_id, stem, term), a batch of queries, broadcast while it
    is small. Texts are read once: the postings of other words are dropped where they are made,
    those of the queries' words are written, with one row a document that counts it. A batch of
    many words is searched by blocks.best(), unless it has stems or groups.
    """
    batch = _Batch(terms)
    if (batch.rows is None or len(batch.rows) > MANY_WORDS) and groups is None and "stem" not in terms.columns:
        return blocks.best(idx, terms, limit)
    words = batch.words([(_ITSELF, _ITSELF)])
    laid = idx.select("doc_id", "len", F.explode(F.array_append("tokens", F.lit(_ITSELF))).alias("term"))
    post = written(laid.join(words, "term").groupBy("doc_id", "len", "stem").agg(F.count(F.lit(1)).alias("tf")))
    n_docs, avg_len = post.where(F.col("stem") == _ITSELF).agg(F.count(F.lit(1)), F.avg("len")).first()
    return _ranked(post.where(F.col("stem") != _ITSELF), n_docs, avg_len, batch, limit, groups)


class _Batch:
    """The words of a batch of queries: fetched and broadcast if they are few, else a table."""

    def __init__(self, terms: DataFrame):
        keyed = terms if "stem" in terms.columns else terms.withColumn("stem", F.col("term"))
        self.keyed = keyed.select("query_id", "stem", "term")
        rows = self.keyed.limit(BROADCAST_ROWS + 1).collect()
        self.rows = rows if len(rows) <= BROADCAST_ROWS else None

    def _made(self, columns: list[str], more: list[tuple] = ()) -> DataFrame:
        schema = self.keyed.select(*columns).schema
        extra = self.keyed.sparkSession.createDataFrame(list(more), schema) if more and self.rows is None else None
        if self.rows is not None:
            return F.broadcast(self.keyed.sparkSession.createDataFrame(sorted({tuple(r[c] for c in columns) for r in self.rows} | set(more), key=repr), schema))
        found = self.keyed.select(*columns).distinct()
        return found if extra is None else found.unionByName(extra)

    def words(self, more: list[tuple] = ()) -> DataFrame:
        """(stem, term), and the rows of more."""
        return self._made(["stem", "term"], more)

    def asked(self) -> DataFrame:
        """(query_id, stem)."""
        return self._made(["query_id", "stem"])


def _ranked(post: DataFrame, n_docs: int, avg_len: float | None, batch: _Batch, limit: int, groups: DataFrame | None = None) -> DataFrame:
    df = post.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    idf = F.greatest(F.log((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg_len or 1.0)))
    # df has no more rows than there are query words; hot words don't meet in one task
    met = join_counted(post, written(df), ["stem"], "n") if batch.rows is None else post.join(F.broadcast(df), "stem")
    summed = met.select("doc_id", "stem", part.alias("part")).join(batch.asked(), "stem").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    summed = summed if groups is None else summed.join(groups, "doc_id")
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy(*(c for c in summed.columns if c not in ("doc_id", "score"))).orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("bigint"))


def write_index(idx: DataFrame, path: str, buckets: int = BUCKETS, parts: int = 4) -> None:
    """Write the postings of index() for search_index(): (term, doc_id, tf, len) by bucket of the
    term's hash, and the number and mean length of the documents.

    Within a bucket documents are spread over `parts` files by hash, so a word that most texts
    hold fills no task; each file is sorted by word, so a search reads few row groups of it.
    """
    lens = idx.select("doc_id", "len", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    laid = lens.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "_part": F.pmod(F.xxhash64("doc_id"), F.lit(parts))})
    laid.repartition("bucket", "_part").sortWithinPartitions("bucket", "term").drop("_part").write.partitionBy("bucket").parquet(f"{path}/postings")
    idx.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/stats")
    idx.select("doc_id").limit(0).write.parquet(f"{path}/ids")


def search_index(spark: SparkSession, path: str, terms: DataFrame, limit: int = 10) -> DataFrame:
    """bm25() over a written index: only the buckets of the batch's words are read, and of a small
    batch only row groups that may hold them."""
    n_docs, avg_len, buckets = spark.read.parquet(f"{path}/stats").first()
    batch = _Batch(terms)
    # an index of no documents has no files to take the columns from
    ids = spark.read.parquet(f"{path}/ids").schema["doc_id"].dataType.simpleString()
    post = spark.read.schema(f"term string, doc_id {ids}, tf bigint, len int, bucket int").parquet(f"{path}/postings")
    asked = sorted({r["term"] for r in batch.rows}) if batch.rows is not None else []
    if 0 < len(asked) <= PUSHED_WORDS:
        wanted = spark.createDataFrame([(t,) for t in asked], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()
        post = post.where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(asked))
    counted = post.select("term", "doc_id", "tf", "len").join(batch.words(), "term").groupBy("doc_id", "len", "stem").agg(F.sum("tf").alias("tf"))
    return _ranked(written(counted), n_docs, avg_len, batch, limit)


def phrase_matches(idx: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, n): documents that hold the phrase's tokens in a row, and how often."""
    wanted = " " + " ".join(t for t in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in phrase).split()) + " "
    line = F.concat(F.lit(" "), F.array_join("tokens", "  "), F.lit(" "))
    doubled = wanted.strip().replace(" ", "  ")
    n = F.size(F.split(line, f"(?= {doubled} )")) - 1 + F.when(line.startswith(f" {doubled} "), 1).otherwise(0)
    return idx.where(F.contains(line, F.lit(f" {doubled} "))).select("doc_id", n.cast("bigint").alias("n"))


def snippet(text: Column, terms: list[str], width: int = 64, before: str = ">>>", after: str = "<<<") -> Column:
    """The window of at most `width` words with most hits, hits marked, cut ends shown by `...`."""
    wanted = {t.lower() for t in terms}

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = (t or "").split()
            hit = [any(p in wanted for p in "".join(c.lower() if c.isalnum() else " " for c in w).split()) for w in words]
            best = at = run = sum(hit[:width])
            at = 0
            for i in range(1, max(1, len(words) - width + 1)):
                run += hit[i + width - 1] - hit[i - 1]
                if run > best:
                    best, at = run, i
            part = [f"{before}{w}{after}" if h else w for w, h in zip(words[at : at + width], hit[at : at + width], strict=True)]
            out.append(("..." if at else "") + " ".join(part) + ("..." if at + width < len(words) else ""))
        return pd.Series(out)

    return cut(text)
