"""Structural queries over commits, code events and the trade tables' call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import text
from tarnwork.operators import assay, instants
from tarnwork.operators.eventlog import json_items, scan, with_payload
from tarnwork.plans.shaping import table
from tarnwork.queries.instants_sql import dated_commits
from tarnwork.queries.log import PAYLOAD
from tarnwork.sources import code

NOW = "2026-05-20"

# --- adapters -------------------------------------------------------------------------------


def functions(spark: SparkSession, d: str) -> DataFrame:
    """function_facts(file, name, is_public, is_async, parameter_count, parameters, return_type) of the code events."""
    ev = with_payload(scan(table(spark, d, "eventlog"), ["code.function"]))
    get = lambda p: F.get_json_object("payload", p)
    params = json_items(get("$.params"))
    rows = ev.select(
        get("$.file").alias("file"), get("$.name").alias("name"), (get("$.is_public") == "true").alias("is_public"), (get("$.is_async") == "true").alias("is_async"),
        F.greatest(F.size(F.coalesce(params, F.array().cast("array<string>"))), F.lit(0)).cast("bigint").alias("parameter_count"), get("$.return_type").alias("return_type"),
    )
    return rows.where("file is not null and name is not null").distinct()


def imports(spark: SparkSession, d: str) -> DataFrame:
    """import_facts(file, import_path): a file that keeps changing with another stands for its importer.

    A pair's count is the sum of its rows in either order; it is kept in each order it is stored in.
    """
    a, b = F.col("file_a"), F.col("file_b")
    pairs = table(spark, d, "co_changes").groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"), F.collect_set(F.struct("file_a", "file_b")).alias("orders"))
    c = pairs.where("n >= 2").select(F.inline("orders"))
    return c.select(F.col("file_a").alias("file"), F.concat(F.lit("crate::"), text.module_path(F.col("file_b"))).alias("import_path")).distinct()


def modules(spark: SparkSession, d: str) -> DataFrame:
    """index_state(path, lines, bytes) of source files, sizes from the lines added and removed."""
    cf = table(spark, d, "commit_files").where(F.col("file_path").rlike(assay.SOURCE_SUFFIX))
    net = F.sum(F.coalesce("lines_added", F.lit(0)) - F.coalesce("lines_removed", F.lit(0)))
    return cf.groupBy(F.col("file_path").alias("path")).agg(F.greatest(net, F.lit(0)).cast("bigint").alias("lines")).withColumn("bytes", F.col("lines") * 40)


def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """(caller, callee, file, line_number, call_type): suppliers call parts."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    s, p = table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    kind = F.when(F.col("l_returnflag") == "R", "method").when(F.col("l_returnflag") == "A", "direct").otherwise("async")
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    return joined.select(F.col("s_name").alias("caller"), F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("callee"), F.col("p_brand").alias("file"), F.col("l_linenumber").cast("bigint").alias("line_number"), kind.alias("call_type"))


def _commits(spark, d):
    return table(spark, d, "commits").select("sha", "message", "author_name", "timestamp").distinct()


def _dated_commits(spark: SparkSession, d: str) -> DataFrame:
    """(sha, author_name, utc_us) of every commit, the latest instant of its copies; read as p2_found reads them."""
    c = table(spark, d, "commits").select("sha", "author_name", "author_email", "timestamp")
    zoned = instants.with_zone(c, instants.repository_name("email", F.col("author_email")), table(spark, d, "repo_zones"))
    zoned = zoned.withColumn("source", F.coalesce("zone", F.lit("UTC")))
    dated = instants.normalise_instants(zoned, "timestamp", "zone", "source", instants.MONTH_FIRST_SLASH_DAY_FIRST_DOT)
    return dated.groupBy("sha").agg(F.max("author_name").alias("author_name"), F.max("utc_us").alias("utc_us"))


def _signals(spark, d):
    return assay.module_signals(modules(spark, d), imports(spark, d), functions(spark, d), _dated_commits(spark, d), table(spark, d, "commit_files"), NOW)


FUNCTIONS = f"""{PAYLOAD}, fn as (select distinct json_extract_string(p, '$.file') as file, json_extract_string(p, '$.name') as name, json_extract_string(p, '$.is_public') = 'true' as is_public,
    json_extract_string(p, '$.is_async') = 'true' as is_async,
    coalesce(case when json_valid(json_extract_string(p, '$.params')) then json_array_length(case when json_type(json_extract_string(p, '$.params')) = 'OBJECT' then '[0]' else json_extract_string(p, '$.params') end) end, 0)::bigint as parameter_count,
    json_extract_string(p, '$.return_type') as return_type from pl where event_type = 'code.function' and json_extract_string(p, '$.file') is not null and json_extract_string(p, '$.name') is not null)"""
MODULE = r"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^(\./)+', ''), '^(src/)+', ''), '(\.rs)+$', ''), '(/mod)+$', ''), '/', '::')"
IMPORTS = f"""pc as (select least(file_a, file_b) as x, greatest(file_a, file_b) as y from co_changes group by 1, 2 having sum(coalesce("count", 0)) >= 2),
    im as (select distinct file_a as file, 'crate::' || {MODULE.format('file_b')} as import_path from co_changes join pc on x = least(file_a, file_b) and y = greatest(file_a, file_b))"""
MODULES = r"""md as (select file_path as path, greatest(sum(coalesce(lines_added, 0) - coalesce(lines_removed, 0)), 0)::bigint as lines, greatest(sum(coalesce(lines_added, 0) - coalesce(lines_removed, 0)), 0)::bigint * 40 as bytes
    from commit_files where regexp_matches(file_path, '\.(rs|py|ts|js|go)$') group by 1)"""
CALLS = """cg as (select s_name as caller, p_name || ' #' || p_partkey as callee, p_brand as file, l_linenumber::bigint as line_number, case l_returnflag when 'R' then 'method' when 'A' then 'direct' else 'async' end as call_type
    from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey)"""
ENTRY = "split_part(path, '/', -1) in (" + ", ".join(f"'{x}'" for x in text.ENTRY_POINTS) + ")"
TEST = r"(regexp_matches(lower(path), '/(test|tests|__tests__|spec|specs)/|/test_') or regexp_matches(lower(path), '_test\.(rs|go|py)$|\.(test|spec)\.(ts|js)$|\.test\.(tsx|jsx)$|_spec\.rb$'))"
SIGNALS = f"""with {FUNCTIONS}, {IMPORTS}, {MODULES},
    imc as (select path, count(distinct file) as importer_count from md join im on contains('::' || import_path || '::', '::' || {MODULE.format('path')} || '::') group by 1),
    {dated_commits()},
    t as (select distinct cf.sha, file_path as path, author_name, day from commit_files cf join oc using (sha)),
    ac as (select path, count(distinct sha) as commit_count, count(distinct author_name) as contributor_count, max(day) as last_day from t group by 1),
    tc as (select path, string_agg(author_name, '|' order by rn) as top_contributors from (select path, author_name, row_number() over (partition by path order by count(distinct sha) desc, author_name) as rn from t group by 1, 2) where rn <= 3 group by 1),
    fc as (select file as path, count(*) as n_calls from fn group by 1),
    sr as (select path, case when count(*) over () = 1 then 0.5 else percent_rank() over (order by bytes) end as file_size_rank from md),
    sg as (select path, coalesce(importer_count, 0) as importer_count,
        case when coalesce(commit_count, 0) = 0 then 'dormant' when date '{NOW}' - last_day <= 7 then 'high' when date '{NOW}' - last_day <= 30 then 'medium' when date '{NOW}' - last_day <= 90 then 'low' else 'dormant' end as activity_level,
        coalesce(commit_count, 0) as commit_count, coalesce(contributor_count, 0) as contributor_count, coalesce(top_contributors, '') as top_contributors, {ENTRY} as is_entry_point, {TEST} as is_test_file,
        (length(regexp_replace(path, '^(\\./)+', '')) - length(replace(regexp_replace(path, '^(\\./)+', ''), '/', '')))::bigint as directory_depth, round(coalesce(n_calls, 0) / 100.0, 6)::double as centrality_score,
        round(file_size_rank, 6) as file_size_rank, coalesce(importer_count, 0) > 0 or {ENTRY} or {TEST} as is_used
        from md left join imc using (path) left join ac using (path) left join tc using (path) left join fc using (path) join sr using (path)),
    sc as (select *, (is_entry_point::int * 20 + least(importer_count * 2, 20) + case activity_level when 'high' then 10 when 'medium' then 5 when 'low' then 2 else 0 end
        + case when commit_count > 50 then 10 when commit_count > 20 then 8 when commit_count > 5 then 5 when commit_count > 0 then 2 else 0 end - is_test_file::int * 5)::bigint as score from sg)
"""


def cochange_pairs(spark, d):
    return assay.co_change_pairs(table(spark, d, "commit_files"))


def _temporal_queries(spark):
    return spark.createDataFrame([("t1", "core query"), ("t2", "src/rank/"), ("t3", "changelog")], "query_id string, query string")


def temporal_neighbors(spark, d):
    co = table(spark, d, "co_changes").groupBy("file_a", "file_b").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    return assay.temporal_neighbours(co, _temporal_queries(spark)).select("query_id", "file", "score", F.col("rank").cast("bigint").alias("rank"))


def moments(spark, d):
    return assay.moments(_commits(spark, d), table(spark, d, "commit_files").select("sha", "file_path").distinct())


def moments_summary(spark, d):
    return assay.moments_summary(_commits(spark, d), table(spark, d, "commit_files").select("sha", "file_path").distinct())


def inventory(spark, d):
    return assay.inventory(modules(spark, d), functions(spark, d), imports(spark, d), "src/%")


def function_facts(spark, d):
    return functions(spark, d)


def function_flags(spark, d):
    """The logged Rust functions written out as source text and parsed again, with their flags."""
    f = functions(spark, d).where(F.col("file").endswith(".rs"))
    params = F.transform(F.sequence(F.lit(1), F.col("parameter_count")), lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit(": (u8, Vec<&str>)")))
    head = F.concat(F.when(F.col("is_public"), "pub ").otherwise(""), F.when(F.col("is_async"), "async ").otherwise(""), F.lit("fn "), "name", F.lit("(\n    "))
    text = F.concat(head, F.when(F.col("parameter_count") > 0, F.array_join(params, ",\n    ")).otherwise(""), F.lit("\n)"), F.coalesce(F.concat(F.lit(" -> "), "return_type"), F.lit("")), F.lit(' {\n    // fn other() {}\n    call("{");\n}\n'))
    facts = code.parse_sources(f.select(F.col("file").alias("path"), text.alias("source")))
    return facts.where("kind = 'function'").select(F.col("path").alias("file"), "name", "is_public", "is_async", F.size("parameters").cast("bigint").alias("parameter_count"), F.col("returns").alias("return_type"), "returns_result", "returns_option", F.col("line").cast("bigint").alias("line")).distinct()


def functions_search(spark, d):
    return assay.search(functions(spark, d), ["name", "file"], "query", ["file", "name", "parameter_count", "is_public", "is_async", F.col("return_type").asc_nulls_first()], 100)


def callers(spark, d):
    return assay.search(call_graph(spark, d), ["callee"], "#17", ["caller", "callee", "file", "line_number", "call_type"], 100)


def callees(spark, d):
    return assay.search(call_graph(spark, d), ["caller"], "0001", ["callee", "caller", "file", "line_number", "call_type"], 100)


def imports_of(spark, d):
    return assay.search(imports(spark, d), ["file"], "src/core", ["file", "import_path"], 100)


def importers_of(spark, d):
    return assay.search(imports(spark, d), ["import_path"], "rank_", ["import_path", "file"], 100)


def module_signals(spark, d):
    return _signals(spark, d)


def orient(spark, d):
    return assay.orient(_signals(spark, d), "src/", 20).select("path", "score", "importer_count", "commit_count", "activity_level")


def recent_changes(spark, d):
    one = _dated_commits(spark, d).withColumn("day", assay.utc_day(F.col("utc_us")))
    touches = table(spark, d, "commit_files").select("sha", "file_path").distinct().join(one, "sha")
    return assay.recent_changes(touches, "2026-03-01", "src/", 50).withColumn("day", F.col("day").cast("string"))


def largest_modules(spark, d):
    m = modules(spark, d)
    total = m.agg(F.sum("lines")).first()[0] or 0
    return m.orderBy(F.desc("lines"), "path").limit(10).select("path", "lines", F.round(F.try_divide(100.0 * F.col("lines"), F.lit(total)), 6).alias("percent"))


def language_rollup(spark, d):
    m = modules(spark, d)
    return m.groupBy(text.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("lines").alias("n_lines"))


def node_universe(spark, d):
    co = table(spark, d, "co_changes")
    return co.select(F.col("file_a").alias("node")).union(co.select("file_b")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        cochange_pairs, temporal_neighbors, moments, moments_summary, inventory, function_facts, function_flags, functions_search, callers, callees, imports_of, importers_of, module_signals, orient, recent_changes, largest_modules,
        language_rollup, node_universe,
    )
}

COMMITS = "c as (select distinct sha, message, author_name, timestamp from commits), cf as (select distinct sha, file_path from commit_files), fc as (select sha, count(*) as n from cf group by 1)"
SQL = {
    "cochange_pairs": """with cf as (select distinct sha, file_path from commit_files where sha is not null and file_path is not null), k as (select sha from cf group by 1 having count(*) between 2 and 50), f as (select cf.* from cf join k using (sha))
        select a.file_path as file_a, b.file_path as file_b, count(*) as "count" from f a join f b on a.sha = b.sha and a.file_path < b.file_path group by 1, 2""",
    "temporal_neighbors": """with q(query_id, query) as (values ('t1', 'core query'), ('t2', 'src/rank/'), ('t3', 'changelog')), w as (select query_id, query, unnest(list_distinct(string_split(lower(query), ' '))) as term from q),
        co as (select file_a, file_b, sum(coalesce("count", 0))::bigint as n from co_changes group by 1, 2), b as (select file_a as seed, file_b as file, n, 0 as side from co union all select file_b, file_a, n, 1 from co),
        m as (select *, row_number() over (partition by query_id, term, side order by n desc, file, seed) as rn from b join w on contains(lower(seed), term)),
        s as (select query_id, file, sum(n)::bigint as score from m where rn <= 30 and not contains(lower(file), lower(query)) group by 1, 2)
        select query_id, file, score, row_number() over (partition by query_id order by score desc, file) as rank from s qualify rank <= 10""",
    "moments": f"""with {COMMITS}, g as (select sha from c where timestamp is not null order by timestamp, sha limit 1)
        select * from (select c.sha, case when c.sha = (select sha from g) then 'genesis' when n > 100 then 'big_bang' when n > 50 then 'major' when lower(message) like '%breaking%' then 'breaking'
        when lower(message) like '%rewrite%' or lower(message) like '%refactor%' then 'rewrite' when lower(message) like '%migrate%' or lower(message) like '%migration%' then 'migration' end as moment_type,
        coalesce(n, 0) as file_count from c left join fc using (sha)) where moment_type is not null""",
    "moments_summary": f"""with {COMMITS} select (select count(*) from c) as total_commits, (select (count(*) > 0)::bigint from c) as genesis, (select count(*) from fc where n > 100) as big_bang, (select count(*) from fc where n > 50 and n <= 100) as major,
        count(*) filter (lower(message) like '%breaking%') as breaking, count(*) filter (lower(message) like '%migrate%' or lower(message) like '%migration%') as migration,
        count(*) filter (lower(message) like '%rewrite%' or lower(message) like '%refactor%') as rewrite from c""",
    "inventory": f"""with {FUNCTIONS}, {IMPORTS}, {MODULES} select path, lines, bytes, (select count(*) from fn where fn.file = md.path) as n_functions, (select count(*) from im where im.file = md.path) as n_imports from md where path like 'src/%' order by path limit 1000""",
    "function_facts": f"with {FUNCTIONS} select * from fn",
    "function_flags": f"""with {FUNCTIONS} select distinct file, name, coalesce(is_public, false) as is_public, coalesce(is_async, false) as is_async, parameter_count, return_type, coalesce(contains(return_type, 'Result'), false) as returns_result,
        coalesce(contains(return_type, 'Option'), false) as returns_option, 1::bigint as line from fn where file like '%.rs'""",
    "functions_search": f"with {FUNCTIONS} select * from fn where name ilike '%query%' or file ilike '%query%' order by file, name, parameter_count, is_public nulls first, is_async nulls first, return_type nulls first limit 100",
    "callers": f"with {CALLS} select * from cg where callee ilike '%#17%' order by caller, callee, file, line_number, call_type limit 100",
    "callees": f"with {CALLS} select * from cg where caller ilike '%0001%' order by callee, caller, file, line_number, call_type limit 100",
    "imports_of": f"with {IMPORTS} select * from im where file ilike '%src/core%' order by file, import_path limit 100",
    "importers_of": f"with {IMPORTS} select * from im where import_path ilike '%rank\\_%' escape '\\' order by import_path, file limit 100",
    "module_signals": SIGNALS + "select * from sg",
    "orient": SIGNALS + "select path, score, importer_count, commit_count, activity_level from sc where path like 'src/%' order by score desc, path limit 20",
    "recent_changes": f"""with {dated_commits()}, t as (select distinct cf.sha, file_path, author_name, day, utc_us from commit_files cf join oc using (sha)),
        k as (select * from t where day >= date '2026-03-01' and contains(file_path, 'src/')), n as (select file_path, count(*) as n_changes, max(struct_pack(day := day, utc_us := utc_us, sha := sha, author_name := author_name)) as r from k group by 1)
        select file_path, n_changes, r.day::varchar as day, r.sha as sha, r.author_name as author_name from n order by r.day desc, r.utc_us desc, file_path limit 50""",
    "largest_modules": f"with {MODULES} select path, lines, round(100.0 * lines / (select sum(lines) from md), 6)::double as percent from md order by lines desc, path limit 10",
    "language_rollup": f"""with {MODULES} select case regexp_extract(path, '\\.([^./]+)$', 1) when 'rs' then 'rust' when 'py' then 'python' when 'ts' then 'typescript' when 'js' then 'javascript' when 'go' then 'go' else 'other' end as language,
        count(*) as n_files, sum(lines)::bigint as n_lines from md group by 1""",
    "node_universe": "select distinct node from (select file_a as node from co_changes union all select file_b from co_changes)",
}
