"""Sources, sinks and small functions: tables are written in the outside formats and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import text
from tarnwork.operators import eventlog, evaluation, feedback, graph
from tarnwork.plans.shaping import new_folder, table
from tarnwork.queries.log import HITS, PAYLOAD
from tarnwork.sources import forge, git_log, markdown, records


def _line(column: str) -> Column:
    return text.first_line(F.col(column))


def _logged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").where(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T[^|\s]*$")).groupBy("sha").agg(F.min(_line("message")).alias("message"), F.min("author_name").alias("author_name"), F.min(F.coalesce("author_email", F.lit(""))).alias("author_email"), F.min("timestamp").alias("timestamp"))


def git_log_files(spark, d):
    """Commits and their files as a text log with numbers of lines, read back as commit_files."""
    c = _logged(spark, d)
    heads = c.select("sha", F.lit(0).alias("k"), F.lit("").alias("p"), F.concat_ws("|", "sha", "message", "author_name", "author_email", "timestamp").alias("line"))
    num = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("-"))
    rows = table(spark, d, "commit_files").join(c.select("sha"), "sha").select("sha", F.lit(1).alias("k"), F.col("file_path").alias("p"), F.concat_ws("\t", num("lines_added"), num("lines_removed"), "file_path").alias("line"))
    path = new_folder(spark, "log")
    heads.unionByName(rows).repartition("sha").sortWithinPartitions("sha", "k", "p", "line").select("line").write.text(path)
    return git_log.read_git_log(spark, path)[1]


def git_log_commits(spark, d):
    """The heads of such a log."""
    c = _logged(spark, d)
    path = new_folder(spark, "log")
    c.select(F.concat_ws("|", "sha", "message", "author_name", "author_email", "timestamp")).write.text(path)
    return git_log.read_git_log(spark, path)[0]


def tags_and_files(spark, d):
    """A tag for every commit with a branch, and the tracked files, as lines of text and back."""
    tags, files = new_folder(spark, "tags"), new_folder(spark, "files")
    table(spark, d, "commits").where("branch is not null").groupBy("sha").agg(F.min("branch").alias("b"), F.min(_line("message")).alias("m")).select(F.concat_ws("|", "b", "sha", F.lit("2024-01-01"), F.lit("Ann"), F.concat(F.lit("a|"), "m"))).write.text(tags)
    table(spark, d, "commit_files").select("file_path").distinct().write.text(files)
    named = git_log.read_tags(spark, tags).select(F.lit("tag").alias("kind"), F.col("tag_name").alias("name"), "message")
    return named.unionByName(git_log.read_tracked_files(spark, files).select(F.lit("file").alias("kind"), F.col("file_path").alias("name"), F.lit(None).cast("string").alias("message")))


def _kind(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "documents").where((F.col("kind") == kind) & F.col("path").isNotNull() & F.col("text").isNotNull()).select(F.col("path").alias("file_path"), "text").distinct()


def session_goals(spark, d):
    """Check boxes of the session documents."""
    return markdown.session_goals(_kind(spark, d, "sessions")).select("session_id", F.col("pos").cast("bigint").alias("pos"), "content", "completed").distinct()


def belief_documents(spark, d):
    """Front matter and evidence of the belief documents."""
    return markdown.belief_docs(_kind(spark, d, "beliefs")).select("file_path", "id", "facets", "confidence", F.col("evidence_count").cast("bigint").alias("evidence_count")).distinct()


def session_titles(spark, d):
    """Ids and titles of the session documents."""
    return markdown.sessions(_kind(spark, d, "sessions")).select("file_path", "id", "title").distinct()


def persona_events(spark, d):
    """Personal events as daily JSON lines, and those behind a known one."""
    ev = table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").cast("string").alias("id"), F.lit("captured").alias("event_type"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").cast("string").alias("source"), F.concat(F.lit('said "'), F.col("event_type"), F.lit('"\n')).alias("content"), F.array(F.lit("a"), F.lit("b")).alias("domains"))
    path = new_folder(spark, "persona")
    ev.write.json(path)
    known = ev.agg(F.min_by("id", F.struct("timestamp", "id"))).first()[0]
    return records.read_persona(spark, path, known).select("id", "timestamp", "source", "content", F.size("domains").cast("bigint").alias("n_domains"))


def query_set(spark, d):
    """The test questions, a fixed number, as one JSON query set and back."""
    q = table(spark, d, "eval_items").where("text is not null").select(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.array(F.col("split")).alias("relevant")).alias("q")).distinct()
    path = new_folder(spark, "queries")
    q.agg(F.collect_list("q").alias("queries")).select(F.lit("tests").alias("name"), "queries").coalesce(1).write.json(path)
    return records.read_query_set(spark, path).select("query_id", "query", F.array_join("relevant", ",").alias("relevant"), F.size("relevant_docs").cast("bigint").alias("n_docs"))


def forge_pages(spark, d):
    """Issues as a tracker's JSON pages, updated since a day."""
    rows = table(spark, d, "forge_issues").select("number", "title", "body", F.upper("state").alias("state"), F.array(F.struct(F.col("labels").alias("name"))).alias("labels"), F.struct(F.col("author").alias("login")).alias("author"), F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), "url").distinct()
    path = new_folder(spark, "forge")
    # one record a page, with the line ends of its texts as JSON writes them
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    found = spark.read.text(path)
    read = forge.parse_pages(found, "issue", "2024-06-01")
    return read.groupBy("state").agg(F.count_distinct("number").alias("n"), F.max("number").alias("most"), F.count("author").alias("n_authors"), F.sum(F.length("labels")).alias("n_label_chars"))


def replace_and_prune(spark, d):
    """Pairs of some files replaced by scraped ones, then pairs of files that are no longer listed dropped."""
    old = table(spark, d, "co_changes").select("file_a", "file_b", "count")
    new = old.where("file_a like '%e%' and file_b like 'src/%'").withColumn("count", F.col("count") + 1)
    kept = eventlog.prune_missing(eventlog.replace_by_key(old, new, "file_a"), table(spark, d, "commit_files").select(F.col("file_path").alias("file_a")), "file_a")
    return kept.groupBy("file_a").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


def backlog_inserts(spark, d):
    """Backlog entries that a scrape adds: issues that are no entries yet, ignored where they are."""
    old = table(spark, d, "forge_refs").select("repo", "ref_number", F.lit("kept").alias("how")).distinct()
    new = table(spark, d, "forge_issues").select(F.regexp_extract("url", r"^https?://[^/]+/([^/]+/[^/]+)", 1).alias("repo"), F.col("number").alias("ref_number"), F.lit("added").alias("how")).where("repo != ''")
    return eventlog.insert_or_ignore(old, new, ["repo", "ref_number"]).groupBy("repo", "how").agg(F.count(F.lit(1)).alias("n"))


def federated_tables(spark, d):
    """Two histories as one table tagged by repository, columns that one lacks NULL."""
    c = table(spark, d, "commits").where("sha is not null")
    odd = F.substring("sha", -1, 1).isin(*"13579bdf")
    both = eventlog.federate({"left": c.where(odd).select("sha", "message"), "right": c.where(~odd).select("sha", "author_name")})
    return both.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count("message").alias("n_messages"), F.count("author_name").alias("n_authors"))


def used_results(spark, d):
    """Logged results by rank, those that a use event names marked as useful."""
    log = table(spark, d, "eventlog")
    shown = feedback.results(log).select("query_id", "doc_id", "rank").withColumn("useful", F.lit(False)).distinct()
    return graph.mark_useful(shown, feedback.usage(log).select("query_id", "doc_id")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.count_if("useful").alias("n_useful"))


def path_matches(spark, d):
    """Logged results judged by the session's committed files, either name within the other."""
    log = table(spark, d, "eventlog")
    shown = feedback.results(log).where("rank is not null").select(F.concat_ws("/", "session_id", "query_id").alias("query_id"), "session_id", "doc_id", "rank").distinct()
    files = feedback.commit_files(log).select("session_id", F.col("file_path").alias("doc")).distinct()
    wanted = shown.select("query_id", "session_id").distinct().join(files, "session_id")
    return evaluation.per_query(shown, shown, wanted, contains=True)


def described_files(spark, d):
    """Every file's path as a result id, its sentence, kind of work by its commits, and a made query id."""
    per = table(spark, d, "commit_files").where("file_path is not null").groupBy("file_path").agg(F.count_distinct("sha").alias("n"), F.count_if(F.col("lines_added") > 100).alias("big"))
    at = F.timestamp_seconds(1_700_000_000 + F.col("n"))
    ident = F.concat(F.lit("././"), "file_path", F.lit("::run"))
    return per.select(text.file_of(ident).alias("file"), text.file_text(F.col("file_path")).alias("sentence"), text.classify_work(F.col("n") - 1, F.col("big"), F.col("n")).alias("work"), text.query_id(at, F.col("file_path")).alias("made"), text.format_result(F.col("n") / 4).alias("quarter"))


def described_commits(spark, d):
    """The sentence under which each commit is embedded."""
    return table(spark, d, "commits").where("sha is not null").select("sha", text.commit_text(F.col("sha"), F.col("message"), F.col("author_name")).alias("sentence")).distinct()


def described_beliefs(spark, d):
    """Each belief as it is shown, and with its metrics and tag."""
    b = table(spark, d, "beliefs").where("id is not null").select("id", "statement", "entrenchment", "file_path", "evidence_count", "evidence_verified", "applied_in", "cited_by_beliefs", "cited_by_sessions").distinct()
    c = [F.col(x) for x in ("statement", "entrenchment", "file_path", "evidence_count", "evidence_verified", "applied_in")]
    return b.select("id", text.belief_text(*c).alias("shown"), text.belief_line(*c, F.col("cited_by_beliefs"), F.col("cited_by_sessions"), F.lit(0)).alias("line"))


def pattern_documents(spark, d):
    """Ids and titles of the design notes."""
    return markdown.patterns(_kind(spark, d, "notes")).select("file_path", "id", "title").distinct()


def described_documents(spark, d):
    """Summary and branches of each document."""
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null").select("doc_id", "text").distinct()
    return docs.select("doc_id", text.document_summary(F.col("text")).alias("summary"), text.complexity(F.col("text")).alias("complexity"))


def json_rows(spark, d):
    """Repositories and zones as JSON lines."""
    return records.to_json_rows(table(spark, d, "repo_zones").select("repo", "name", "zone").distinct())


def _domains(spark: SparkSession, d: str) -> DataFrame:
    manifest = F.regexp_replace(F.regexp_replace(F.regexp_replace("file_path", r"\.rs$", "/Cargo.toml"), r"\.ts$", "/package.json"), r"\.py$", "/setup.py")
    return graph.detect_domains(table(spark, d, "commit_files").select(F.split_part("file_path", F.lit("/"), F.lit(2)).alias("repo"), manifest.alias("path")))


def repo_domains(spark, d):
    """Domains of folders by the manifests in them, source files standing for manifests."""
    return _domains(spark, d).select("repo", F.array_join("domains", ",").alias("domains"))


def routed_nodes(spark, d):
    """The folders that a question about JavaScript goes to."""
    return graph.route(_domains(spark, d).withColumnRenamed("repo", "id"), "How does our javascript client retry?").select("id")


QUERIES = {
    f.__name__: f
    for f in (
        git_log_files, git_log_commits, tags_and_files, session_goals, belief_documents, session_titles, persona_events, query_set, forge_pages, replace_and_prune, backlog_inserts, federated_tables, used_results, path_matches, described_files,
        described_commits, described_beliefs, pattern_documents, described_documents, json_rows, repo_domains, routed_nodes,
    )
}

_FIRST = "split_part(replace(message, chr(13), ''), chr(10), 1)"
_LOGGED = rf"c as (select sha, min({_FIRST}) as message, min(author_name) as author_name, min(coalesce(author_email, '')) as author_email, min(timestamp) as timestamp from commits where regexp_matches(timestamp, '^\d{{4}}-\d{{2}}-\d{{2}}T[^|\s]*$') group by 1)"


def _docs(kind: str) -> str:
    name = r"regexp_extract(file_path, '([^/]+)\.md$', 1)"
    field = r"nullif(trim(regexp_replace(regexp_extract(regexp_extract(text, '(?s)\A---\n(.*?)\n---', 1), '(?m)^{0}:[ \t]*(.*)$', 1), '^[\"'']|[\"'']\s*$', '', 'g')), '')"
    legacy = r"nullif(trim(regexp_extract(text, '(?mi)^\*\*{0}\*\*:[ \t]*(.*)$', 1)), '')"
    both = lambda f: f"coalesce({field.format(f)}, {legacy.format(f)})"
    title = r"case when regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1) <> '' then regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1) else trim(regexp_extract(text, '(?m)^\s*(\S.*)$', 1)) end"
    return f"""t as (select distinct path as file_path, text from documents where kind = '{kind}' and path is not null and text is not null),
        m as (select *, {both('id')} as id, coalesce({both('id')}, {name}) as name, {both('facets')} as facets, try_cast({both('confidence')} as double) as confidence, coalesce({both('title')}, {title}) as title from t)"""


_DOMAINS = r"with dm as (select split_part(file_path, '/', 2) as repo, case when regexp_matches(file_path, '\.rs$') then 'rust' when regexp_matches(file_path, '\.ts$') then 'javascript' when regexp_matches(file_path, '\.py$') then 'python' end as d from commit_files)"

SQL = {
    "git_log_files": f"""with {_LOGGED} select distinct sha, file_path, case when coalesce(lines_added, 0) > 0 and coalesce(lines_removed, 0) = 0 then 'added' when coalesce(lines_added, 0) = 0 and coalesce(lines_removed, 0) > 0 then 'deleted' else 'modified' end as change_type,
        lines_added, lines_removed from commit_files join c using (sha) where file_path is not null""",
    "git_log_commits": f"with {_LOGGED} select * from c",
    "tags_and_files": f"select 'tag' as kind, min(branch) as name, 'a|' || min({_FIRST}) as message from commits where branch is not null and sha is not null group by sha union all select distinct 'file', file_path, null from commit_files where file_path <> ''",
    "session_goals": rf"""with {_docs('sessions')}, g as (select name, regexp_extract_all(text, '(?m)^\s*[-*] \[([ xX])\] (.+)$', 1) as a, regexp_extract_all(text, '(?m)^\s*[-*] \[([ xX])\] (.+)$', 2) as b from m)
        select distinct name as session_id, unnest(range(0, len(a)))::bigint as pos, trim(unnest(b)) as content, lower(unnest(a)) = 'x' as completed from g""",
    "belief_documents": rf"""with {_docs('beliefs')}, s as (select *, list_filter(string_split(chr(10) || text, chr(10) || '## '), lambda x: starts_with(x, 'Evidence')) as secs from m)
        select distinct file_path, id, facets, confidence, case when len(secs) = 0 then 0 else len(regexp_extract_all(substr(secs[1], instr(secs[1], chr(10)) + 1), '(?m)^[-*] (.+)$', 1)) end::bigint as evidence_count from s""",
    "session_titles": f"with {_docs('sessions')} select distinct file_path, name as id, title from m",
    "persona_events": """with e as (select event_id::varchar as id, epoch_us(ts) // 1000000 as timestamp, user_id::varchar as source, 'said "signup"' || chr(10) as content, 2::bigint as n_domains from events where event_type = 'signup'),
        k as (select min(struct_pack(timestamp := timestamp, id := id)) as k from e) select e.* from e, k where e.timestamp > k.k.timestamp or (e.timestamp = k.k.timestamp and e.id > k.k.id)""",
    "query_set": "select distinct item_id::varchar as query_id, text as query, split as relevant, 0::bigint as n_docs from eval_items where text is not null",
    "forge_pages": """with r as (select distinct number, title, body, state, labels, author, created_at, updated_at, url from forge_issues where number is not null and coalesce(updated_at, '9') >= '2024-06-01')
        select lower(coalesce(state, '')) as state, count(distinct number) as n, max(number) as most, count(author) as n_authors, sum(case when labels is null then 2 else length(to_json([labels])) end)::bigint as n_label_chars from r group by 1""",
    "replace_and_prune": """with nw as (select file_a, file_b, "count" + 1 as n from co_changes where file_a like '%e%' and file_b like 'src/%'), al as (select file_a, "count" as n from co_changes where file_a not in (select file_a from nw) union all select file_a, n from nw)
        select file_a, count(*) as n, sum(n)::bigint as total from al where file_a in (select file_path from commit_files) group by 1""",
    "backlog_inserts": r"""with o as (select distinct repo, ref_number from forge_refs), n as (select distinct regexp_extract(url, '^https?://[^/]+/([^/]+/[^/]+)', 1) as repo, number as ref_number from forge_issues where regexp_extract(url, '^https?://[^/]+/([^/]+/[^/]+)', 1) <> '')
        select repo, 'kept' as how, count(*) as n from o group by 1 union all select repo, 'added', count(*) from n anti join o using (repo, ref_number) group by 1""",
    "federated_tables": """with c as (select *, right(sha, 1) in ('1', '3', '5', '7', '9', 'b', 'd', 'f') as odd from commits where sha is not null) select case when odd then 'left' else 'right' end as repo, count(*) as n, count(message) filter (odd) as n_messages, count(author_name) filter (not odd) as n_authors from c group by 1""",
    "used_results": HITS + ", us as (select distinct json_extract_string(p, '$.query_id') as query_id, json_extract_string(p, '$.result_used') as doc_id from pl where event_type = 'scry.use'), sh as (select distinct query_id, doc_id, rank from res) select rank, count(*) as n, count(*) filter ((query_id, doc_id) in (select query_id, doc_id from us where query_id is not null and doc_id is not null)) as n_useful from sh group by 1",
    "path_matches": HITS + """, sh as (select distinct session_id || '/' || query_id as query_id, session_id, doc_id, rank from res where rank is not null), wa as (select distinct sh.query_id, file_path as doc from sh join cf using (session_id)),
        fi as (select wa.query_id, wa.doc, min(rank) as first from wa left join sh on sh.query_id = wa.query_id and (contains(sh.doc_id, wa.doc) or contains(wa.doc, sh.doc_id)) group by 1, 2),
        st as (select query_id, count(*) as n, min(first) as best, count(*) filter (first <= 5) as f5, count(*) filter (first <= 10) as f10 from fi group by 1)
        select query_id, round(coalesce(1.0::double / best, 0.0), 6) as rr, round(case when n is null then 1.0 else f5 / n end, 6) as recall_5, round(case when n is null then 1.0 else f10 / n end, 6) as recall_10 from (select distinct query_id from sh) left join st using (query_id)""",
    "described_files": "with p as (select file_path, count(distinct sha) as n, count(*) filter (lines_added > 100) as big from commit_files where file_path is not null group by 1) select regexp_replace(file_path, '^(\\./)+', '') as file, 'File: ' || file_path || ' (' || case regexp_extract(file_path, '\\.([^.]*)$', 1) "
    + " ".join(f"when '{x}' then '{name}'" for x, name in text.FILE_TYPES.items())
    + " else 'file' end || ')' as sentence, case when n = 1 then 'exploration' when big > 0 then 'pattern-work' when n > 10 then 'major-feature' when n - 1 < 3 then 'experiment' else 'feature' end as work, 'q_' || strftime(timestamp 'epoch' + to_seconds(1700000000 + n), '%Y%m%d_%H%M%S') || '_' || left(md5(file_path), 3) as made, case when n % 4 = 0 then (n // 4)::varchar else printf('%.2f', n / 4) end as quarter from p",
    "described_beliefs": """with b as (select distinct id, statement, entrenchment, file_path, evidence_count as ec, evidence_verified as ev, applied_in as ap, cited_by_beliefs as cb, cited_by_sessions as cs from beliefs where id is not null)
        select id, statement || ' (' || coalesce(entrenchment, '?') || ', ' || file_path || ') [evidence: ' || ec || '/' || ev || case when ap > 0 then ', ' || ap || ' applied' else '' end || ']' as shown,
            statement || ' [' || concat_ws(' | ', 'use: ' || cb || '+' || cs, 'truth: ' || ec || '/' || ev, case when ap > 0 then ap || ' applied' end) || case when ec = 0 and cb + cs <= 1 then ' WEAK' when ev = 0 and ec > 0 then ' UNVERIFIED' else '' end || '] (' || coalesce(entrenchment, '?') || ', ' || file_path || ')' as line from b""",
    "pattern_documents": f"with {_docs('notes')} select distinct file_path, name as id, title from m",
    "described_documents": r"""with t as (select distinct doc_id, text from documents where doc_id is not null and text is not null), b as (select doc_id, text, regexp_replace(text, '(?s)^---\n.*?\n---\n', '') as body from t)
        select doc_id, left(trim(regexp_replace(regexp_replace(body, '(?m)^#.*$', '', 'g'), '\s+', ' ', 'g')), 500) as summary, (1 + len(regexp_extract_all(text, '\b(?:if|elif|switch|for|while|case|match)\b')))::bigint as complexity from b""",
    "json_rows": "select distinct to_json(struct_pack(repo := repo, name := name, zone := zone))::varchar as value from repo_zones",
    "repo_domains": _DOMAINS + " select repo, string_agg(distinct d, ',' order by d) as domains from dm where d is not null group by 1",
    "routed_nodes": _DOMAINS + " select distinct repo as id from dm where d is not null and (contains('how does our javascript client retry?', lower(repo)) or repo in (select repo from dm where d = 'javascript'))",
    "described_commits": f"select distinct sha, left(sha, 7) || ': ' || {_FIRST} || ' (' || coalesce(author_name, '?') || ')' as sentence from commits where sha is not null",
}
