"""Text queries: commit messages, query rewriting, full-text search, secret scanning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.functions import text
from tarnwork.operators import fts, scanning
from tarnwork.operators.feedback import session_queries
from tarnwork.plans.shaping import table
from tarnwork.queries.log import PAYLOAD, QUERY_ROWS

BATCH = [("q1", "which lock file dropped the sparse scores"), ("q2", "index decision"), ("q3", "caché grafo"), ("q4", "retry guard budget ranking pass")]


def _batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BATCH, "query_id string, query string")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "path", "source", "kind").where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])


def _messages(spark, d):
    return table(spark, d, "commits").select("sha", "message").where("sha is not null and message is not null").distinct()


def _asked(spark, d):
    return session_queries(table(spark, d, "eventlog")).select("query").where("query is not null").distinct()


def conventional_commits(spark, d):
    p = text.conventional(F.col("message"))
    return _messages(spark, d).select("sha", p["type"].alias("type"), p["scope"].alias("scope"), p["breaking"].alias("breaking"), p["pr_ref"].alias("pr_ref"), F.array_join(F.transform(p["issue_refs"], lambda x: x.cast("string")), ",").alias("issue_refs"))


def commit_types(spark, d):
    p = text.conventional(F.col("message"))
    return _messages(spark, d).groupBy(F.coalesce(p["type"], F.lit("other")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count(p["scope"]).alias("n_scoped"))


def change_types(spark, d):
    return table(spark, d, "commit_files").groupBy(text.change_type(F.col("lines_added"), F.col("lines_removed")).alias("derived"), "change_type").agg(F.count(F.lit(1)).alias("n"))


def clean_messages(spark, d):
    return _messages(spark, d).select("sha", text.clean_commit_message(F.col("message")).alias("query"))


def intent_detect(spark, d):
    q = F.col("query")
    return _asked(spark, d).select("query", text.intent(q).alias("intent"), text.is_code_like(q).alias("code_like"), text.is_lexical_query(q).alias("lexical"))


def query_rewrite(spark, d):
    q = F.col("query")
    return _asked(spark, d).select("query", F.array_join(text.technical_terms(q), "|").alias("terms"), text.fts_query(q).alias("fts_query"))


def bm25_topk(spark, d):
    return fts.bm25(fts.index(_docs(spark, d), "doc_id", "text"), fts.query_terms(_batch(spark)), 10)


def bm25_documents(spark, d):
    """The documents whose id is divisible by 100, whole, as queries against all documents."""
    docs = _docs(spark, d)
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return fts.bm25(fts.index(docs, "doc_id", "text"), fts.query_terms(asked), 10)


def bm25_porter(spark, d):
    """Ranking with stemmed, folded words; checked against an embedded full-text engine in the tests."""
    idx = fts.index(_docs(spark, d), "doc_id", "text", folded=True)
    return fts.bm25(idx, fts.stemmed_terms(idx, fts.query_terms(_batch(spark), folded=True)), 10)


def lexical_union(spark, d):
    """Three corpora searched apart, merged by score: documents, commit messages, issues."""
    issues = table(spark, d, "forge_issues").select(F.concat(F.lit("issue:"), F.col("number").cast("string")).alias("doc_id"), "title", "body").dropDuplicates(["doc_id"])
    commits = table(spark, d, "commits").select(F.concat(F.lit("commit:"), "sha").alias("doc_id"), "message", "author_name").dropDuplicates(["doc_id"])
    docs = _docs(spark, d).withColumn("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    terms = fts.query_terms(_batch(spark))
    parts = [fts.bm25(fts.index(df, "doc_id", *cols), terms, 10).withColumn("corpus", F.lit(name)) for name, df, cols in (("issues", issues, ("title", "body")), ("commits", commits, ("message", "author_name")), ("documents", docs, ("text",)))]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where("rank <= 10").select("query_id", "corpus", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def phrase_search(spark, d):
    return fts.phrase_matches(fts.index(_docs(spark, d), "doc_id", "text"), "the lock was free")


def snippets(spark, d):
    """Best passages for one query over all documents that hold its rarest word."""
    docs = _docs(spark, d).where(F.contains(F.lower("text"), F.lit("retry guard")))
    return docs.select("doc_id", fts.snippet(F.col("text"), ["retry", "guard"], 16).alias("snippet"))


def result_snippets(spark, d):
    return _docs(spark, d).select("doc_id", text.snippet(F.col("text"), F.concat(F.lit("pattern."), "kind")).alias("snippet"), text.document_title(F.col("text")).alias("title"))


def secret_scan(spark, d):
    return scanning.scan_secrets(_docs(spark, d), "doc_id", "text", "path")


#: Text that matches each of several patterns, with an id in it.
PLANTED = [("gh", "p_", 36), ("glpat", "-", 22), ("AGE-SECRET-KEY", "-1", 58), ("password: ", '"', 12), ("xoxb", "-1-", 9)]


def secret_scan_planted(spark, d):
    """The scan over documents with secrets planted in every twentieth, as the tables hold none."""
    digest = F.md5(F.col("doc_id").cast("string"))
    lines = [F.concat(F.lit(a + b), F.upper(F.substring(F.concat(digest, digest), 1, n)) if a.startswith("AGE") else F.substring(F.concat(digest, digest), 1, n), F.lit(b if b == '"' else "")) for a, b, n in PLANTED]
    docs = _docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 20 == 0, F.concat_ws("\r\n", F.col("text"), *lines)).otherwise(F.col("text")))
    return scanning.scan_secrets(docs, "doc_id", "text", "path")


def remote_urls(spark, d):
    p = text.remote_parts(F.regexp_replace("url", r"/(issues|pull)/\d+$", ""))
    both = table(spark, d, "forge_issues").select("url").unionByName(table(spark, d, "forge_prs").select("url")).distinct()
    return both.groupBy(p["host"].alias("host"), p["owner"].alias("owner"), p["repo"].alias("repo")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (conventional_commits, commit_types, change_types, clean_messages, intent_detect, query_rewrite, bm25_topk, bm25_documents, bm25_porter, lexical_union, phrase_search, snippets, result_snippets, secret_scan, secret_scan_planted, remote_urls)
}

MESSAGES = "m as (select distinct sha, message, split_part(replace(message, chr(13), ''), chr(10), 1) as line from commits where sha is not null and message is not null)"
CC = r"'^(\w+)(?:\(([^)]+)\))?(!)?:\s*(.+)$'"
ASKED = f"{PAYLOAD}, {QUERY_ROWS}, a as (select distinct query, lower(query) as l from q where query is not null and session_id is not null)"
CODE_LIKE = r"(contains(query, '::') or contains(query, '()') or (contains(query, '_') and not contains(query, ' ')) or regexp_full_match(query, '[\p{L}\p{N}_]*'))"
INTENT = """case when contains(l, 'when ') or starts_with(l, 'when') or contains(l, ' added') or contains(l, ' changed') or contains(l, 'history') or contains(l, 'introduced') then 'temporal'
        when contains(l, 'why ') or starts_with(l, 'why') or contains(l, 'decided') or contains(l, 'chose') or contains(l, 'reason') then 'rationale'
        when (contains(l, 'how ') or starts_with(l, 'how')) and (contains(l, 'work') or contains(l, 'implement') or contains(l, 'does')) then 'mechanism'
        when contains(l, 'what is') or contains(l, 'what''s') or starts_with(l, 'explain') or starts_with(l, 'describe') then 'definition' else 'general' end"""
STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TERMS = rf"""list_transform(list_filter(list_transform(regexp_split_to_array(query, '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_-]', '', 'g')),
    lambda w: w <> '' and lower(w) not in ({STOPS}) and (contains(w, '_') or regexp_matches(w, '^.+\p{{Lu}}') or length(w) > 2)), lambda w: case when contains(w, '-') then '"' || w || '"' else w end)"""


def _bm25_sql(docs: str, out: str = "s", limit: int = 10, batch: str = "") -> str:
    """CTEs `out`(query_id, doc_id, score, rank) over a CTE of (doc_id, body) named docs."""
    return f"""{out}_t as (select doc_id, regexp_extract_all(lower(body), '[a-z0-9]+') as toks from {docs}), {out}_n as (select count(*) as n_docs, avg(len(toks)) as avg_len from {out}_t),
        {out}_x as (select doc_id, len(toks) as dl, unnest(toks) as term from {out}_t), {out}_w as (select distinct query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from {batch or 'batch'}),
        {out}_p as (select doc_id, dl, term, count(*) as tf from {out}_x where term in (select term from {out}_w) group by 1, 2, 3), {out}_d as (select term, count(*) as n from {out}_p group by 1),
        {out}_s as (select query_id, doc_id, round(sum(greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) as score
            from {out}_p join {out}_d using (term) join {out}_w using (term), {out}_n group by 1, 2),
        {out} as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from {out}_s qualify rank <= {limit})"""


BATCH_SQL = "batch(query_id, query) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in BATCH) + ")"
DOCS = "dc as (select distinct on (doc_id) doc_id, text as body, path, kind from documents where doc_id is not null and text is not null order by doc_id)"


def _planted_sql() -> str:
    digest = "md5(doc_id::varchar) || md5(doc_id::varchar)"
    lines = ", ".join(f"'{a + b}' || " + (f"upper(left({digest}, {n}))" if a.startswith("AGE") else f"left({digest}, {n})") + (f" || '{b}'" if b == '"' else "") for a, b, n in PLANTED)
    docs = f"case when doc_id % 20 = 0 then concat_ws(chr(13) || chr(10), text, {lines}) else text end as body"
    return _secret_sql().replace("text as body", docs, 1)


def _secret_sql() -> str:
    esc = lambda r: r.replace("'", "''")
    lines = "ln as (select doc_id, unnest(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10))) as line_text, generate_subscripts(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)), 1) as line from dc where path is null or not (path like '%.lock' or split_part(path, '/', -1) in ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml')))"
    parts = " union all ".join(f"select doc_id, line::bigint as line, instr(line_text, regexp_extract(line_text, '{esc(r)}'))::bigint as \"column\", '{n}' as pattern, '{s}' as severity, regexp_extract(line_text, '{esc(r)}') as m from ln where regexp_matches(line_text, '{esc(r)}')" for n, r, s in text.SECRETS)
    return f"""with {DOCS}, {lines}, f as ({parts}) select doc_id, line, "column", pattern, severity, case when length(m) <= 8 then repeat('*', length(m)) else left(m, 4) || '...' || right(m, 4) end as matched from f"""


SQL = {
    "conventional_commits": rf"""with {MESSAGES} select sha, nullif(regexp_extract(line, {CC}, 1), '') as type, nullif(regexp_extract(line, {CC}, 2), '') as scope,
        case when regexp_extract(line, {CC}, 1) <> '' then regexp_extract(line, {CC}, 3) = '!' end as breaking, try_cast(nullif(regexp_extract(line, '\(#(\d{{1,18}})\)\s*$', 1), '') as bigint) as pr_ref,
        coalesce(array_to_string(regexp_extract_all(message, '(?i)(?:fix(?:es)?|close[sd]?|resolve[sd]?)[:\s]+#?(\d+)', 1), ','), '') as issue_refs from m""",
    "commit_types": f"with {MESSAGES} select coalesce(nullif(regexp_extract(line, {CC}, 1), ''), 'other') as type, count(*) as n, count(nullif(regexp_extract(line, {CC}, 2), '')) as n_scoped from m group by 1",
    "change_types": """select case when coalesce(lines_added, 0) > 0 and coalesce(lines_removed, 0) = 0 then 'added' when coalesce(lines_added, 0) = 0 and coalesce(lines_removed, 0) > 0 then 'deleted' else 'modified' end as derived,
        change_type, count(*) as n from commit_files group by 1, 2""",
    "clean_messages": rf"""with {MESSAGES} select sha, trim(split_part(case when regexp_matches(line, '^[A-Za-z0-9()]{{0,19}}:') then trim(regexp_replace(line, '^[A-Za-z0-9()]{{0,19}}:', '')) else line end, ' (#', 1)) as query from m""",
    "intent_detect": f"""with {ASKED} select query, {INTENT} as intent, {CODE_LIKE} as code_like,
        starts_with(l, 'find ') or starts_with(l, 'where is ') or starts_with(l, 'show me ') or contains(l, ' defined') or regexp_matches(query, '::|\\(\\)|fn |struct |const |impl ') or {CODE_LIKE}
        or (contains(query, '(') and contains(query, ')')) or l like '% fn' or l like '% struct' as lexical from a""",
    "query_rewrite": f"""with {ASKED} select query, coalesce(array_to_string({TERMS}, '|'), '') as terms, case when {CODE_LIKE} then case when contains(query, ' ') then '"' || replace(query, '"', '""') || '"' else query end
        when len({TERMS}) > 0 then array_to_string({TERMS}, ' OR ') else query end as fts_query from a""",
    "bm25_topk": f"with {BATCH_SQL}, {DOCS}, {_bm25_sql('dc')} select * from s",
    "bm25_documents": f"with {DOCS}, ba as (select doc_id as query_id, body as query from (select doc_id, regexp_replace(body, '\\bOR\\b', ' ', 'g') as body from dc where doc_id % 100 = 0)), {_bm25_sql('dc', 's', 10, 'ba')} select * from s",
    "lexical_union": f"""with {BATCH_SQL}, {DOCS}, d1 as (select 'doc:' || doc_id as doc_id, body from dc), d2 as (select distinct on (sha) 'commit:' || sha as doc_id, message || ' ' || coalesce(author_name, '') as body from commits order by sha),
        d3 as (select distinct on (number) 'issue:' || number as doc_id, coalesce(title, '') || ' ' || coalesce(body, '') as body from forge_issues order by number), {_bm25_sql('d1', 'a')}, {_bm25_sql('d2', 'b')}, {_bm25_sql('d3', 'c')},
        u as (select 'documents' as corpus, * from a union all select 'commits', * from b union all select 'issues', * from c)
        select query_id, corpus, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, corpus, doc_id, score from u) qualify rank <= 10""",
    "phrase_search": f"""with {DOCS}, t as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(body), '[a-z0-9]+'), '  ') || ' ' as line from dc) select doc_id, len(regexp_extract_all(line, ' the  lock  was  free '))::bigint as n
        from t where contains(line, ' the  lock  was  free ')""",
    "snippets": rf"""with {DOCS}, w as (select doc_id, regexp_extract_all(body, '[^\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+') as ws from dc where contains(lower(body), 'retry guard')), h as (select *, list_transform(ws, lambda x: (list_has_any(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+'), ['retry', 'guard']))::int) as hs from w),
        r as (select *, list_transform(range(0, greatest(1, len(ws) - 15)), lambda i: list_sum(hs[i + 1:i + 16])) as runs from h), a as (select *, list_position(runs, list_max(runs)) - 1 as first from r)
        select doc_id, case when first > 0 then '...' else '' end || array_to_string(list_transform(range(first + 1, least(first + 16, len(ws)) + 1), lambda i: case when hs[i] = 1 then '>>>' || ws[i] || '<<<' else ws[i] end), ' ') || case when first + 16 < len(ws) then '...' else '' end as snippet from a""",
    "result_snippets": rf"""with {DOCS}, l as (select doc_id, body, list_filter(string_split(replace(body, chr(13), ''), chr(10)), lambda x: trim(x) <> '') as ls from dc), f as (select *, trim(regexp_replace(ls[1], '^#+', '')) as t1,
            trim(coalesce(list_filter(ls[2:], lambda x: not regexp_matches(trim(x), '^(\*\*|---|id:|status:)'))[1], '')) as b1 from l), s as (select *, trim(replace(case when len(ls) = 0 then body else t1 || ' — ' || b1 end, chr(10), ' ')) as flat from f)
        select doc_id, case when len(ls) > 0 and b1 = '' then t1 when length(flat) <= 200 then flat else left(flat, 200) || '...' end as snippet,
            case when regexp_extract(body, '(?m)^#\s+(.+?)\s*$', 1) <> '' then regexp_extract(body, '(?m)^#\s+(.+?)\s*$', 1) else trim(regexp_extract(body, '(?m)^\s*(\S.*)$', 1)) end as title from s""",
    "secret_scan": _secret_sql(),
    "secret_scan_planted": _planted_sql(),
    "remote_urls": r"""with u as (select distinct url from (select url from forge_issues union all select url from forge_prs)), b as (select regexp_replace(url, '/(issues|pull)/\d+$', '') as x from u)
        select split_part(x, '/', 3) as host, split_part(x, '/', 4) as owner, split_part(x, '/', 5) as repo, count(*) as n from b group by 1, 2, 3""",
}
