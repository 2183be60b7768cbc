"""Structural queries: inventory, imports, calls, module signals, moments, orientation, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import text
from tarnwork.plans.shaping import small

#: Words, about, that a containment search broadcasts at a time.
BATCH = 1000
SOURCE_SUFFIX = r"\.(rs|py|ts|js|go)$"


def like_pattern(pattern: str) -> str:
    """A LIKE pattern that finds `pattern` itself anywhere, its wildcards escaped."""
    return "%" + pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def search(df: DataFrame, columns: list[str], pattern: str, order: list[str], limit: int = 100) -> DataFrame:
    """Rows one of whose columns contains the pattern, without case, the first `limit` by order."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(like_pattern(pattern)), F.lit(False))
    return df.where(found).orderBy(*order).limit(limit)


def inventory(modules: DataFrame, functions: DataFrame, imports: DataFrame, pattern: str = "%", limit: int = 1000) -> DataFrame:
    """Modules whose path is LIKE the pattern as given, with counts; the counts are aggregated once, not per row."""
    f = functions.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n_functions"))
    i = imports.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n_imports"))
    joined = modules.where(F.col("path").like(pattern)).join(f, "path", "left").join(i, "path", "left")
    return joined.select("path", "lines", "bytes", F.coalesce("n_functions", F.lit(0)).alias("n_functions"), F.coalesce("n_imports", F.lit(0)).alias("n_imports")).orderBy("path").limit(limit)


def moments(commits: DataFrame, commit_files: DataFrame, big: int = 100, major: int = 50) -> DataFrame:
    """(sha, moment_type, file_count): one exclusive label per commit, in order of weight."""
    counts = commit_files.groupBy("sha").agg(F.count(F.lit(1)).alias("file_count"))
    # the first commit by timestamp and sha: a global minimum, no sort
    genesis = commits.where("timestamp is not null").agg(F.min(F.struct("timestamp", "sha")).alias("g")).select(F.col("g.sha").alias("g_sha"))
    m = F.lower("message")
    joined = commits.join(counts, "sha", "left").join(F.broadcast(genesis), F.col("sha") == F.col("g_sha"), "left")
    kind = (
        F.when(F.col("g_sha").isNotNull(), "genesis")
        .when(F.col("file_count") > big, "big_bang")
        .when(F.col("file_count") > major, "major")
        .when(m.contains("breaking"), "breaking")
        .when(m.contains("rewrite") | m.contains("refactor"), "rewrite")
        .when(m.contains("migrate") | m.contains("migration"), "migration")
    )
    return joined.select("sha", kind.alias("moment_type"), F.coalesce("file_count", F.lit(0)).alias("file_count")).where("moment_type is not null")


def moments_summary(commits: DataFrame, commit_files: DataFrame, big: int = 100, major: int = 50) -> DataFrame:
    """One row of overlapping counts."""
    m = F.lower("message")
    words = commits.agg(
        F.count(F.lit(1)).alias("total_commits"), F.when(F.count(F.lit(1)) > 0, 1).otherwise(0).cast("bigint").alias("genesis"), F.count_if(m.contains("breaking")).alias("breaking"),
        F.count_if(m.contains("migrate") | m.contains("migration")).alias("migration"), F.count_if(m.contains("rewrite") | m.contains("refactor")).alias("rewrite"),
    )
    sizes = commit_files.groupBy("sha").count().agg(F.count_if(F.col("count") > big).alias("big_bang"), F.count_if((F.col("count") > major) & (F.col("count") <= big)).alias("major"))
    # one row each, brought together by a union
    names = [*words.columns, *sizes.columns]
    return words.unionByName(sizes, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in names))


def utc_day(utc_us: Column) -> Column:
    """The calendar day in UTC of an instant."""
    day_us = F.lit(86_400_000_000)
    return F.date_add(F.lit("1970-01-01").cast("date"), ((utc_us - F.pmod(utc_us, day_us)) / day_us).cast("int"))


def importer_counts(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, importer_count): files whose import path holds the module's path between `::`.

    Import paths are laid out as their runs of segments, so containment is an equi-join.
    """
    parts = F.split("import_path", "::")
    ends = F.sequence(F.lit(1), F.size(parts))
    runs = F.flatten(F.transform(ends, lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.array_join(F.slice(parts, i, n), "::"))))
    laid = imports.select("file", F.explode(F.array_distinct(runs)).alias("module")).distinct()
    named = modules.select("path", text.module_path(F.col("path")).alias("module"))
    return named.join(laid, "module").groupBy("path").agg(F.count_distinct("file").alias("importer_count"))


def top_contributors(touches: DataFrame, most: int = 3) -> DataFrame:
    """(path, top_contributors): the authors of most commits to each path, joined by |."""
    counted = touches.groupBy("path", "author_name").agg(F.count_distinct("sha").alias("n"))
    ranked = counted.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "author_name"))).where(F.col("rn") <= most)
    return ranked.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "author_name"))), lambda x: x["author_name"]), "|").alias("top_contributors"))


def size_rank(modules: DataFrame) -> DataFrame:
    """(path, file_size_rank): share of modules that are smaller, 0.5 for a single module.

    Sizes fall into buckets of equal ratio, 64 to a doubling, so there are at most 4,096 whatever
    the modules; totals of the buckets are summed up in one task, sizes within each bucket apart.
    """
    sizes = modules.where("bytes is not null").groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.log2(F.greatest("bytes", F.lit(0)) + 1.0) * 64).cast("int"))
    upto = lambda w, by: F.coalesce(F.sum("n").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy(F.lit(0))
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", upto(everything, "bucket").alias("below"), F.sum("n").over(everything).alias("total"))
    placed = sizes.withColumn("within", upto(Window.partitionBy("bucket"), "bytes")).join(F.broadcast(buckets), "bucket")
    rank = F.when(F.col("total") == 1, F.lit(0.5)).otherwise((F.col("below") + F.col("within")) / (F.col("total") - 1))
    return modules.join(placed.select("bytes", rank.alias("file_size_rank")), "bytes").select("path", "file_size_rank")


def module_signals(modules: DataFrame, imports: DataFrame, functions: DataFrame, commits: DataFrame, commit_files: DataFrame, now: str) -> DataFrame:
    """Every module with its derived signals as of the day `now`; a fixed number of joins, whatever the number of modules.

    commits: (sha, author_name, utc_us).
    """
    path = F.col("path")
    one_commit = commits.groupBy("sha").agg(F.max("author_name").alias("author_name"), utc_day(F.max("utc_us")).alias("day"))
    touches = commit_files.select("sha", F.col("file_path").alias("path")).distinct().join(one_commit, "sha")
    activity = touches.groupBy("path").agg(F.count_distinct("sha").alias("commit_count"), F.count_distinct("author_name").alias("contributor_count"), F.max("day").alias("last_day"))
    calls = functions.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n_calls"))
    joined = modules.join(importer_counts(modules, imports), "path", "left").join(activity, "path", "left").join(top_contributors(touches), "path", "left").join(calls, "path", "left").join(size_rank(modules), "path")
    zero = lambda c: F.coalesce(c, F.lit(0))
    days = F.datediff(F.lit(now).cast("date"), F.col("last_day"))
    entry, test = text.is_entry_point(path), text.is_test_file(path)
    return joined.select(
        "path", zero("importer_count").alias("importer_count"), text.activity(zero("commit_count"), days).alias("activity_level"), zero("commit_count").alias("commit_count"), zero("contributor_count").alias("contributor_count"),
        F.coalesce("top_contributors", F.lit("")).alias("top_contributors"), entry.alias("is_entry_point"), test.alias("is_test_file"), text.directory_depth(path).alias("directory_depth"),
        F.round(zero("n_calls") / 100.0, 6).alias("centrality_score"), F.round("file_size_rank", 6).alias("file_size_rank"), ((zero("importer_count") > 0) | entry | test).alias("is_used"),
    )


def orient_score(signals: DataFrame) -> DataFrame:
    level = F.create_map(*(F.lit(x) for x in ("high", 10, "medium", 5, "low", 2, "dormant", 0)))
    n = F.col("commit_count")
    score = (
        F.col("is_entry_point").cast("int") * 20 + F.least(F.col("importer_count") * 2, F.lit(20)) + level[F.col("activity_level")]
        + F.when(n > 50, 10).when(n > 20, 8).when(n > 5, 5).when(n > 0, 2).otherwise(0) - F.col("is_test_file").cast("int") * 5
    )
    return signals.withColumn("score", score.cast("bigint"))


def orient(signals: DataFrame, prefix: str = "", limit: int = 10) -> DataFrame:
    return orient_score(signals.where(F.col("path").startswith(prefix))).orderBy(F.desc("score"), "path").limit(limit)


def recent_changes(touches: DataFrame, since: str, contains: str | None = None, limit: int = 10, compat: bool = False) -> DataFrame:
    """The latest change of each file since a day, newest first, with the file's number of changes.

    touches: (sha, file_path, day, author_name), with a column utc_us changes of one day are
    ordered by it. compat caps the rows at limit * 3 before one row per file is kept, and so
    may return fewer files than asked for.
    """
    at = ["day", "utc_us"] if "utc_us" in touches.columns else ["day"]
    kept = touches.where(F.col("day") >= F.lit(since).cast("date"))
    if contains:
        kept = kept.where(F.contains("file_path", F.lit(contains)))
    if compat:
        kept = kept.orderBy(*(F.desc(c) for c in at), "file_path", "sha").limit(limit * 3)
    per_file = kept.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_changes"), F.max(F.struct(*at, "sha", "author_name")).alias("r"))
    newest = per_file.orderBy(*(F.desc(f"r.{c}") for c in at), "file_path").limit(limit)
    return newest.select("file_path", "n_changes", F.col("r.day").alias("day"), F.col("r.sha").alias("sha"), F.col("r.author_name").alias("author_name"))


def temporal_neighbours(co_changes: DataFrame, queries: DataFrame, limit: int = 10, fetch: int = 3) -> DataFrame:
    """(query_id, file, score): files that change together with those a query's words name.

    Per word and direction the `limit * fetch` strongest rows count; files that contain the
    whole query are left out. queries: (query_id, query). Containment is no equi-join, so the
    distinct words are broadcast, BATCH of them at a time; more take further passes.
    """
    words = queries.select("query_id", "query", F.explode(F.array_distinct(F.split(F.lower(F.trim("query")), r"\s+"))).alias("term")).where("term != ''")
    terms = words.select("term").distinct()
    passes = max(1, -(-terms.count() // BATCH))
    both = co_changes.select(F.col("file_a").alias("seed"), F.col("file_b").alias("file"), "count", F.lit(0).alias("side")).unionByName(co_changes.select(F.col("file_b").alias("seed"), F.col("file_a").alias("file"), "count", F.lit(1).alias("side")))
    told = None
    for i in range(passes):
        some = terms if passes == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i)
        found = both.join(F.broadcast(some), F.contains(F.lower("seed"), F.col("term")))
        told = found if told is None else told.unionByName(found)
    met = told.join(small(words), "term")
    order = Window.partitionBy("query_id", "term", "side").orderBy(F.desc("count"), "file", "seed")
    top = met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit * fetch)
    summed = top.where(~F.contains(F.lower("file"), F.lower("query"))).groupBy("query_id", "file").agg(F.sum("count").alias("score"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "file")))
    return ranked.where(F.col("rank") <= limit)


def co_change_pairs(commit_files: DataFrame, most: int = 50) -> DataFrame:
    """(file_a, file_b, count) of commits with 2 to `most` distinct files."""
    files = commit_files.where("sha is not null and file_path is not null").select("sha", "file_path").distinct()
    sized = files.join(files.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most)), "sha")
    # at most `most` files are gathered per commit, the larger ones are gone by now
    lists = sized.groupBy("sha").agg(F.array_sort(F.collect_list("file_path")).alias("f"))
    f = F.col("f")
    pairs = F.flatten(F.transform(f, lambda x, i: F.transform(F.slice(f, i + 2, F.greatest(F.size(f) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("file_a"), y.alias("file_b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.file_a", "p.file_b").agg(F.count(F.lit(1)).alias("count"))
