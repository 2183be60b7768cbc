"""Beliefs, verification, evaluation, training sets, backlog, context and milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import text
from tarnwork.operators import assay as ops
from tarnwork.operators import backlog, beliefs, evaluation, eventlog, feedback, fts, training, verify
from tarnwork.plans.shaping import new_folder, small, table, written
from tarnwork.queries import assay
from tarnwork.queries.log import HITS, PAYLOAD
from tarnwork.queries.retrieval import COMMIT_HITS, NEAR, _commit_hits, _nearest
from tarnwork.queries.search import DOCS, _bm25_sql, _docs

CLAIMS = [
    ("b1", "few-big", "temporal", "derive-moments | summary.big_bang", "<= 100000"),
    ("b1", "any-commit", "temporal", "derive-moments | summary.total_commits", "> 0"),
    ("b1", "unknown", "temporal", "derive-moments | summary.nothing", "> 0"),
    ("b2", "callers", "assay", 'callers --pattern "ring" | count(distinct caller)', ">= 1"),
    ("b2", "functions", "assay", 'functions --pattern "query"', "> 1000000"),
    ("b2", "field", "assay", 'functions --pattern "query" | count(distinct secret)', "> 1"),
    ("b3", "authors", "sql", "SELECT count(DISTINCT author_name) FROM commits", "> 3"),
    ("b3", "public", "sql", "WITH p AS (SELECT is_public FROM function_facts WHERE is_public = 1) SELECT count(*) FROM p", "= 1"),
    ("b3", "write", "sql", "DELETE FROM commits", "= 0"),
    ("b4", "expectation", "sql", "SELECT 1", "~= 1"),
]


def _verified(spark, d):
    commits = table(spark, d, "commits").select("sha", "message", "author_name", "timestamp").distinct()
    tables = {"call_graph": assay.call_graph(spark, d), "function_facts": assay.functions(spark, d), "import_facts": assay.imports(spark, d), "commits": commits, "commit_files": table(spark, d, "commit_files").select("sha", "file_path").distinct()}
    return verify.verify(spark, [dict(zip(("belief_id", "label", "type", "text", "expect"), c, strict=True)) for c in CLAIMS], tables)


def verification_results(spark, d):
    return _verified(spark, d).select("belief_id", "label", "type", "value", "status")


def verification_counts(spark, d):
    return verify.verification_counts(_verified(spark, d))


def _beliefs(spark, d):
    return table(spark, d, "beliefs").where("id is not null").dropDuplicates(["id"])


def belief_audit(spark, d):
    return beliefs.audit(_beliefs(spark, d), table(spark, d, "belief_code_reach"))


def belief_audit_top(spark, d):
    return beliefs.audit(_beliefs(spark, d), table(spark, d, "belief_code_reach"), order="weak", limit=10).select("id", "n_flags", "flags")


def belief_metrics(spark, d):
    return beliefs.metrics_summary(beliefs.audit(_beliefs(spark, d), table(spark, d, "belief_code_reach")))


def session_citations(spark, d):
    """Sessions that logged queries, evidence of beliefs, other sessions or documents name."""
    docs = _docs(spark, d).select(F.lit(None).cast("string").alias("owner"), "text")
    events = eventlog.with_payload(eventlog.scan(table(spark, d, "eventlog"), ["belief.surface", "session.started", "scry.query"])).select("event_type", "payload").where("payload is not null")
    named = events.select(F.when(F.col("event_type") == "session.started", F.get_json_object("payload", "$.session_id")).alias("owner"), F.col("payload").alias("text")).distinct()
    return beliefs.citations(named.select(F.col("owner").alias("id")).where("id is not null"), docs.unionByName(named))


def grounding_reach(spark, d):
    """Query vectors as beliefs, their nearest vectors as commits (by order key), parts as files, callers as functions."""
    near = _nearest(spark, d, 22).select(F.col("query_id").alias("belief_id"), F.col("vec_id").cast("string").alias("sha"), "score")
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".rs")).alias("file_path"))
    fns = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("file"))
    return beliefs.grounding(near, files, fns, least=0.2).withColumn("reach_score", F.round("reach_score", 6))


def grounding_by_label(spark, d):
    """The three nearest vectors of every family (label) among the 22 nearest."""
    near = _nearest(spark, d, 22).join(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("family")), "vec_id")
    return beliefs.top_per_family(near.select(F.col("query_id").alias("belief_id"), F.col("vec_id").alias("doc_id"), "score", "family")).withColumn("score", F.round("score", 6))


def lexical_grounding(spark, d):
    grounded = table(spark, d, "belief_code_reach").select(F.lower(F.trim("belief_id")).alias("belief_id")).where("belief_id is not null")
    return beliefs.lexical_grounding(_beliefs(spark, d), grounded, assay.functions(spark, d))


# --- evaluation -----------------------------------------------------------------------------


def _questions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, retrieved, relevant): test questions, their ten best documents, documents that hold their first five words."""
    q = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")).where("query is not null").distinct()
    docs = _docs(spark, d)
    idx = fts.index(docs, "doc_id", "text")
    retrieved = fts.bm25(idx, fts.query_terms(q), 10)
    key = lambda toks: F.array_join(toks, " ")
    start = q.select("query_id", key(F.slice(fts.tokens(F.col("query")), 1, 5)).alias("gram"))
    toks = F.col("tokens")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - 4, F.lit(1))), lambda i: key(F.slice(toks, i, 5)))
    laid = idx.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(grams)).alias("gram"))
    return q, retrieved, laid.join(small(start), "gram").select("query_id", "doc").distinct()


def query_scores(spark, d):
    return evaluation.per_query(*_questions(spark, d))


def bm25_indexed(spark, d):
    """All test questions through a written index of the documents."""
    q = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")).where("query is not null").distinct()
    path = new_folder(spark, "index")
    fts.write_index(fts.index(_docs(spark, d), "doc_id", "text"), path)
    return fts.search_index(spark, path, fts.query_terms(q), 10)


def mrr_recall(spark, d):
    return evaluation.summary(evaluation.per_query(*_questions(spark, d)))


def latency_percentiles(spark, d):
    """Nearest-rank percentiles of event values by type."""
    return evaluation.nearest_rank_percentiles(table(spark, d, "events"), "value", (50, 95), "event_type")


def score_distribution(spark, d):
    return evaluation.score_distribution(feedback.results(table(spark, d, "eventlog")), "score", "rank")


def queryset_from_commits(spark, d):
    c = table(spark, d, "commits").select("sha", "message", "timestamp").distinct().groupBy("sha", "message").agg(F.max("timestamp").alias("timestamp"))
    return evaluation.queryset_from_commits(c, table(spark, d, "commit_files"), limit=100)


def commit_ground_truth(spark, d):
    """Found commits judged by their own sessions: reciprocal rank of the first commit with files of the query's words."""
    hits = _commit_hits(spark, d)
    relevant = table(spark, d, "commit_files").where(F.contains("file_path", F.lit("index"))).select("sha").distinct()
    pairs = hits.select("query_id").distinct().join(hits.join(relevant.withColumnRenamed("sha", "doc_id"), "doc_id").select("query_id", F.col("doc_id").alias("doc")), "query_id")
    return evaluation.per_query(hits.select("query_id").distinct(), hits, pairs)


def cochange_precision(spark, d):
    """Of each file's ten strongest stored partners, how many truly share a commit with it."""
    a, b = F.col("file_a"), F.col("file_b")
    told = table(spark, d, "co_changes").where(a != b).groupBy(F.least(a, b).alias("file_a"), F.greatest(a, b).alias("file_b")).agg(F.sum(F.coalesce("count", F.lit(0))).alias("count")).where("count > 0")
    stored = told.unionByName(told.select(b.alias("file_a"), a.alias("file_b"), "count"))
    top = backlog.latest_per_group(stored, ["file_a"], [F.desc("count"), F.asc("file_b")], 10)
    true = ops.co_change_pairs(table(spark, d, "commit_files"))
    pair = top.select("file_a", F.col("rn").alias("rank"), F.least("file_a", "file_b").alias("x"), F.greatest("file_a", "file_b").alias("y"))
    met = pair.join(true.select(F.col("file_a").alias("x"), F.col("file_b").alias("y"), F.lit(True).alias("hit")), ["x", "y"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return met.groupBy("file_a").agg(F.round(F.count_if((F.col("rank") <= 5) & F.col("hit")) / F.least(F.lit(5), F.count(F.lit(1))), 6).alias("p5"), F.round(F.count_if("hit") / F.least(F.lit(10), F.count(F.lit(1))), 6).alias("p10"))


def belief_self_retrieval(spark, d):
    """MRR and hit rate of beliefs searched by their own statements."""
    b = written(_beliefs(spark, d).where("statement is not null").select("id", "statement"))
    q = b.select(F.col("id").alias("query_id"), F.col("statement").alias("query"))
    found = fts.bm25(fts.index(b, "id", "statement"), fts.query_terms(q), 10)
    scores = evaluation.per_query(q, found, b.select(F.col("id").alias("query_id"), F.col("id").alias("doc")))
    return scores.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall_10"), 6).alias("hit_rate"))


def belief_co_retrieval(spark, d):
    """Per belief with reached files: how many of them its statement's words find among file names."""
    reach = table(spark, d, "belief_code_reach").select(F.lower(F.trim("belief_id")).alias("id"), "file_path").where("id is not null").distinct()
    b = _beliefs(spark, d).where("statement is not null").select("id", F.explode(F.array_distinct(fts.tokens(F.col("statement")))).alias("word"))
    named = reach.select("id", "file_path", F.explode(F.array_distinct(fts.tokens(F.col("file_path")))).alias("word"))
    hit = named.join(b, ["id", "word"]).select("id", "file_path").distinct().withColumn("hit", F.lit(1))
    return reach.join(_beliefs(spark, d).select("id"), "id").join(hit, ["id", "file_path"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_files"), F.count("hit").alias("n_found"))


def ablation(spark, d):
    """Whether titles help to find issues by their own bodies' first words."""
    issues = written(table(spark, d, "forge_issues").select(F.col("number").cast("string").alias("id"), "title", "body").where("body is not null").dropDuplicates(["id"]))
    q = issues.select(F.col("id").alias("query_id"), F.array_join(F.slice(fts.tokens(F.col("body")), 1, 6), " ").alias("query")).where("query != ''")
    own = q.select("query_id", F.col("query_id").alias("doc"))
    score = lambda *cols: evaluation.per_query(q, fts.bm25(fts.index(issues, "id", *cols), fts.query_terms(q), 10), own)
    return evaluation.ablation(score("title", "body"), score("body"))


# --- training sets --------------------------------------------------------------------------


def triplets_cochange(spark, d):
    return training.cochange_triplets(table(spark, d, "co_changes"), both_ways=True)


def triplets_session(spark, d):
    ev = eventlog.with_payload(eventlog.scan(table(spark, d, "eventlog"), prefix="session."))
    obs = ev.select(F.get_json_object("payload", "$.session_id").alias("session_id"), F.get_json_object("payload", "$.content").alias("item")).where("session_id is not null and length(item) > 20")
    return training.session_triplets(obs)


def triplets_dependency(spark, d):
    return training.dependency_triplets(assay.call_graph(spark, d))


def triplets_commit(spark, d):
    commits = table(spark, d, "commits").select("sha", "message", "author_name", "timestamp").distinct()
    moments = ops.moments(commits, table(spark, d, "commit_files").select("sha", "file_path").distinct())
    return training.commit_triplets(commits, table(spark, d, "commit_files"), assay.functions(spark, d), moments)


# --- backlog, context, milestones -----------------------------------------------------------


def ref_backlog_counts(spark, d):
    return backlog.backlog_counts(table(spark, d, "forge_refs").distinct())


def refs_pending(spark, d):
    return backlog.pending_refs(table(spark, d, "forge_refs").distinct(), 50).select("repo", "ref_number", "discovered")


def refs_discovered(spark, d):
    """Pull requests that commit payloads name and the backlog lacks."""
    ev = eventlog.with_payload(eventlog.scan(table(spark, d, "eventlog"), ["git.commit"]))
    rows = ev.select("seq", F.get_json_object("payload", "$.sha").alias("sha"), F.get_json_object("payload", "$.parsed.pr_ref").try_cast("bigint").alias("pr_ref"))
    return backlog.discover_refs(rows.where("sha is not null"), table(spark, d, "forge_refs"))


def context_docs(spark, d):
    return backlog.context(table(spark, d, "patterns").distinct(), "index").select("id", "title", "layer")


def knowledge_latest(spark, d):
    """Session decisions as personal knowledge: each supersedes the user's event before it."""
    ev = table(spark, d, "events").where("event_type in ('signup', 'purchase')").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), "user_id", "event_type")
    chained = ev.withColumn("supersedes", F.lag("id").over(Window.partitionBy("user_id", "event_type").orderBy("timestamp", "id"))).withColumn("domains", F.array("event_type"))
    return backlog.knowledge(chained, ["signup"], limit=50).select("id", "user_id", "timestamp")


def spec_milestones(spark, d):
    """Patterns as specs with a milestone per later version among all patterns of their layer."""
    p = table(spark, d, "patterns").where("current_milestone is not null").select("id", "layer", "current_milestone").distinct()
    versions = p.select("layer", F.col("current_milestone").alias("version")).distinct()
    m = p.join(versions, "layer").select(F.col("id").alias("spec_id"), F.col("current_milestone").alias("current"), "version", F.lit("pending").alias("status"))
    return backlog.next_milestone(m)


QUERIES = {
    f.__name__: f
    for f in (
        verification_results, verification_counts, belief_audit, belief_audit_top, belief_metrics, session_citations, grounding_reach, grounding_by_label, lexical_grounding, query_scores, bm25_indexed, mrr_recall, latency_percentiles, score_distribution,
        queryset_from_commits, commit_ground_truth, cochange_precision, belief_self_retrieval, belief_co_retrieval, ablation, triplets_cochange, triplets_session, triplets_dependency, triplets_commit, ref_backlog_counts, refs_pending,
        refs_discovered, context_docs, knowledge_latest, spec_milestones,
    )
}

BELIEFS = "b as (select distinct on (id) * from beliefs where id is not null order by id)"
AUDIT = f"""{BELIEFS}, rf as (select lower(trim(belief_id)) as k, count(distinct file_path) as n_files from belief_code_reach group by 1), au as (select id, status, (cited_by_beliefs + cited_by_sessions)::bigint as total_use, evidence_verified::bigint as evidence_verified,
    coalesce(n_files, 0)::bigint as n_files, list_filter([case when evidence_count = 0 then 'no-evidence' end, case when evidence_verified = 0 and evidence_count > 0 then 'unverified' end, case when cited_by_beliefs + cited_by_sessions = 0 then 'unused' end,
    case when applied_in = 0 then 'no-applications' end, case when coalesce(n_files, 0) = 0 then 'floating' end], lambda x: x is not null) as fl from b left join rf on k = lower(id)),
    a as (select id, status, total_use, evidence_verified, n_files, len(fl)::bigint as n_flags, coalesce(array_to_string(fl, ','), '') as flags from au)"""
QUESTIONS = f"""{DOCS}, qs as (select distinct item_id::varchar as query_id, text as query from eval_items where text is not null), {_bm25_sql('dc', 's', 10, 'qs')},
    st as (select query_id, array_to_string(list_slice(regexp_extract_all(lower(query), '[a-z0-9]+'), 1, 5), ' ') as gram from qs), dl as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(body), '[a-z0-9]+'), ' ') || ' ' as line from dc),
    rl as (select query_id, doc_id as doc from st join dl on contains(line, ' ' || gram || ' '))"""
SCORES = """fr as (select rl.query_id, rl.doc, min(rank) as first from rl left join s on s.query_id = rl.query_id and s.doc_id = rl.doc group by 1, 2),
    sx as (select query_id, count(*) as n, min(first) as best, count(*) filter (first <= 5) as f5, count(*) filter (first <= 10) as f10 from fr group by 1),
    sc as (select query_id, round(coalesce(1.0::double / best, 0.0), 6) as rr, round(case when n is null then 1.0 else f5 / n end, 6) as recall_5, round(case when n is null then 1.0 else f10 / n end, 6) as recall_10 from (select distinct query_id from qs) left join sx using (query_id))"""


def _values() -> str:
    facts = {
        ("b1", "few-big"): "(select count(*) from (select sha from (select distinct sha, file_path from commit_files) group by 1 having count(*) > 100))", ("b1", "any-commit"): "(select count(*) from (select distinct sha, message, author_name, timestamp from commits))",
        ("b2", "callers"): "(select count(distinct caller) from cg where callee ilike '%ring%')", ("b2", "functions"): "(select count(*) from fn where name ilike '%query%' or file ilike '%query%')",
        ("b3", "authors"): "(select count(distinct author_name) from commits)", ("b3", "public"): "(select count(*) from fn where is_public)", ("b4", "expectation"): "1",
    }
    parts = []
    for b, label, kind, _, expect in CLAIMS:
        v = facts.get((b, label))
        if v is None or expect.startswith("~"):
            parts.append(f"select '{b}' as belief_id, '{label}' as label, '{kind}' as type, {v + '::double' if v else 'null::double'} as value, 'error' as status")
        else:
            parts.append(f"select '{b}' as belief_id, '{label}' as label, '{kind}' as type, {v}::double as value, case when {v} {expect} then 'pass' else 'contested' end as status")
    return f"with {assay.FUNCTIONS}, {assay.CALLS}, vr as (" + " union all ".join(parts) + ")"


def _hash_sql(seed: int, *columns: str) -> str:
    return f"('0x' || left(md5(concat_ws(chr(1), '{seed}', {', '.join(columns)})), 15))::bigint"


def _negatives_sql(anchors: str, pool: str, banned: str, seed: int = 7) -> str:
    """CTEs up to ng(anchor, negative) over CTEs anchors(anchor, owner), pool(item) and banned(owner, item)."""
    return f"""pl as (select item, row_number() over (order by {_hash_sql(seed + 1, 'item')} % 64, {_hash_sql(seed, 'item')}, item) - 1 as place, count(*) over () as size from (select distinct item from {pool} where item is not null)),
        bn as (select distinct owner, item from {banned}), nb as (select owner, count(*) as n from bn group by 1), an as (select distinct anchor, owner from {anchors}),
        tr as (select anchor, owner, item, {_hash_sql(seed, 'anchor', 'item')} as h, (place - {_hash_sql(seed + 2, 'anchor')} % size + size) % size as k, coalesce(n, 0) + 2 as most from an left join nb using (owner), pl where item <> anchor),
        fr as (select *, case when k < 8 then 1 when k < 64 then 2 when k < most then 3 end as round from tr anti join bn using (owner, item)), rd as (select anchor, min(round) as least from fr group by 1),
        ng as (select anchor, (min(struct_pack(h := h, item := item))).item as negative from fr join rd using (anchor) where case least when 1 then k < 8 when 2 then k < 64 else k < most end group by 1)"""


SQL = {
    "triplets_cochange": f"""with sp as (select least(file_a, file_b) as x, greatest(file_a, file_b) as y, sum(coalesce("count", 0)) as n from co_changes where file_a <> file_b group by 1, 2), bo as (select x as owner, y as item from sp union all select y, x from sp),
        pr as (select x as anchor, y as positive from sp where n >= 2 union all select y, x from sp where n >= 2), ax as (select anchor, anchor as owner from pr), {_negatives_sql('ax', 'bo', 'bo')} select anchor, positive, negative from pr join ng using (anchor)""",
    "triplets_session": f"""with {PAYLOAD}, ob as (select distinct json_extract_string(p, '$.session_id') as owner, json_extract_string(p, '$.content') as item from pl where event_type like 'session.%' and length(json_extract_string(p, '$.content')) > 20 and json_extract_string(p, '$.session_id') is not null),
        pr as (select * from (select owner, item as anchor, lead(item) over (partition by owner order by {_hash_sql(7, 'item')}, item) as positive from ob) where positive is not null), {_negatives_sql('pr', 'ob', 'ob').replace('pl as', 'pp as').replace(', pl where', ', pp where')}
        select anchor, positive, negative from pr join ng using (anchor)""",
    "triplets_dependency": f"""with {assay.CALLS}, pr as (select distinct caller as anchor, callee as positive from cg), bo as (select anchor as owner, positive as item from pr), ax as (select anchor, anchor as owner from pr), {_negatives_sql('ax', 'bo', 'bo')}
        select anchor, positive, negative from pr join ng using (anchor)""",
    "triplets_commit": f"""with {assay.FUNCTIONS}, mo as ({assay.SQL['moments']}), f as (select distinct file as file_path, name as item from fn), cm as (select distinct sha, message as anchor from (select distinct sha, message, author_name, timestamp from commits) where length(message) > 30),
        pr as (select distinct anchor, item as positive, case moment_type when 'breaking' then 3.0 when 'big_bang' then 2.0 when 'migration' then 1.5 when 'rewrite' then 1.2 else 1.0 end::double as weight from cm join (select distinct sha, file_path from commit_files) using (sha) join f using (file_path) left join (select distinct sha, moment_type from mo) using (sha)),
        bo as (select anchor as owner, positive as item from pr), ax as (select anchor, anchor as owner from pr), {_negatives_sql('ax', 'f', 'bo').replace('pl as', 'pp as').replace(', pl where', ', pp where')} select anchor, positive, weight, negative from pr join ng using (anchor)""",
    "verification_results": _values() + " select * from vr",
    "verification_counts": _values() + " select belief_id, count(*) as total, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'contested') as contested, count(*) filter (status = 'error') as errored from vr group by 1",
    "belief_audit": f"with {AUDIT} select * from a",
    "belief_audit_top": f"with {AUDIT} select id, n_flags, flags from a order by n_flags desc, id limit 10",
    "belief_metrics": f"with {AUDIT} select count(*) as n, coalesce(sum(total_use), 0)::bigint as uses, count(*) filter (n_files > 0) as grounded, count(*) filter (evidence_verified > 0) as verified, count(*) filter (n_flags = 0) as healthy from a",
    "session_citations": f"""with {PAYLOAD}, {DOCS}, ne as (select distinct case when event_type = 'session.started' then json_extract_string(p, '$.session_id') end as owner, p as text from pl where event_type in ('belief.surface', 'session.started', 'scry.query') and p is not null),
        tx as (select null as owner, body as text from dc union all select * from ne), w as (select owner, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z0-9]+(?:-[A-Za-z0-9]+)+)', 1))) as id from tx)
        select id, count(*) as n_texts from w join (select distinct owner as id from ne where owner is not null) using (id) where owner is null or owner <> id group by 1""",
    "grounding_reach": f"""with {NEAR}, g as (select query_id as belief_id, vec_id::bigint as sha, score from nk where rank <= 22 and score >= 0.2), cf as (select distinct l_orderkey as sha, 'part/' || l_partkey || '.rs' as file_path from lineitem),
        fc as (select 'part/' || p_partkey || '.rs' as file_path, count(*) as function_count from part group by 1) select belief_id, file_path, round(max(score), 6) as reach_score, count(distinct sha) as commit_count, coalesce(max(function_count), 0) as function_count
        from g join cf using (sha) left join fc using (file_path) group by 1, 2""",
    "grounding_by_label": f"with {NEAR} select query_id as belief_id, vec_id as doc_id, round(score, 6) as score, label::bigint as family, row_number() over (partition by query_id, label order by score desc, vec_id) as rn from nk where rank <= 22 qualify rn <= 3",
    "lexical_grounding": f"""with {assay.FUNCTIONS}, {BELIEFS}, l as (select id from b where id not in (select lower(trim(belief_id)) from belief_code_reach where belief_id is not null)),
        w as (select distinct id as belief_id, word from (select id, unnest(string_split(lower(id), '-')) as word from l) where length(word) >= 3 and word not in ({", ".join(f"'{x}'" for x in text.BELIEF_STOP_WORDS)})),
        n as (select distinct file, name, unnest(list_distinct(string_split(lower(name), '_'))) as word from fn), m as (select belief_id, file as file_path, count(distinct word) as n_words from w join n using (word) group by 1, 2)
        select * from m qualify row_number() over (partition by belief_id order by n_words desc, file_path) <= 5""",
    "bm25_indexed": f"with {QUESTIONS} select * from s",
    "query_scores": f"with {QUESTIONS}, {SCORES} select * from sc",
    "mrr_recall": f"""with {QUESTIONS}, {SCORES} select count(*) as n_queries, round(avg(rr), 6) as mrr, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10,
        case when avg(rr) >= 0.5 and avg(recall_10) >= 0.7 then 'good' when avg(rr) >= 0.3 and avg(recall_10) >= 0.5 then 'acceptable' else 'poor' end as band from sc""",
    "latency_percentiles": "with l as (select event_type, list_sort(list(value)) as v from events where value is not null group by 1) select event_type, len(v)::bigint as n, v[floor((len(v) - 1) * 50 / 100.0 + 0.5)::bigint + 1] as p50, v[floor((len(v) - 1) * 95 / 100.0 + 0.5)::bigint + 1] as p95 from l",
    "score_distribution": HITS + "select rank, count(*) as n, round(avg(score), 6) as mean, round(var_pop(score), 6) as variance, round(min(score), 6) as least, round(max(score), 6) as most from res group by 1",
    "queryset_from_commits": r"""with c as (select sha, message, max(timestamp) as timestamp from commits group by 1, 2), f as (select distinct sha, file_path from commit_files), k as (select sha, message, timestamp, count(*) as n, string_agg(file_path, '|' order by file_path) as files from c join f using (sha)
        where length(message) > 20 and length(message) < 200 and not regexp_matches(message, '(?i)^(merge|wip|fixup|squash)') group by 1, 2, 3 having count(*) between 1 and 10), m as (select *, split_part(replace(message, chr(13), ''), chr(10), 1) as line from k)
        select sha, trim(split_part(case when regexp_matches(line, '^[A-Za-z0-9()]{0,19}:') then trim(regexp_replace(line, '^[A-Za-z0-9()]{0,19}:', '')) else line end, ' (#', 1)) as query, files from m order by timestamp desc nulls last, sha limit 100""",
    "commit_ground_truth": f"""with {COMMIT_HITS}, qs as (select distinct query_id from s), rl as (select distinct query_id, doc_id as doc from s where doc_id in (select sha from commit_files where contains(file_path, 'index'))), {SCORES} select * from sc""",
    "cochange_precision": f"""with sp as (select least(file_a, file_b) as x, greatest(file_a, file_b) as y, sum(coalesce("count", 0)) as n from co_changes where file_a <> file_b group by 1, 2 having sum(coalesce("count", 0)) > 0),
        st as (select x as file_a, y as file_b, n from sp union all select y, x, n from sp), t as (select *, row_number() over (partition by file_a order by n desc, file_b) as rank from st qualify rank <= 10),
        p as ({assay.SQL['cochange_pairs']}), m as (select t.file_a, rank, p.file_a is not null as hit from t left join p on p.file_a = least(t.file_a, t.file_b) and p.file_b = greatest(t.file_a, t.file_b))
        select file_a, round(count(*) filter (rank <= 5 and hit) / least(5, count(*)), 6) as p5, round(count(*) filter (hit) / least(10, count(*)), 6) as p10 from m group by 1""",
    "belief_self_retrieval": f"""with {BELIEFS}, bs as (select id as doc_id, statement as body from b where statement is not null), qs as (select doc_id as query_id, body as query from bs), {_bm25_sql('bs', 's', 10, 'qs')}, rl as (select query_id, query_id as doc from qs), {SCORES}
        select count(*) as n, round(avg(rr), 6) as mrr, round(avg(recall_10), 6) as hit_rate from sc""",
    "belief_co_retrieval": f"""with {BELIEFS}, rc as (select distinct lower(trim(belief_id)) as id, file_path from belief_code_reach where belief_id is not null), w as (select id, regexp_extract_all(lower(statement), '[a-z0-9]+') as ws from b where statement is not null)
        select id, count(*) as n_files, count(*) filter (list_has_any(regexp_extract_all(lower(file_path), '[a-z0-9]+'), ws)) as n_found from rc join (select id from b) using (id) left join w using (id) group by 1""",
    "ablation": f"""with i as (select distinct on (number) number::varchar as id, title, body from forge_issues where body is not null order by number),
        qs as (select id as query_id, array_to_string(list_slice(regexp_extract_all(lower(body), '[a-z0-9]+'), 1, 6), ' ') as query from i where len(regexp_extract_all(lower(body), '[a-z0-9]+')) > 0),
        d1 as (select id as doc_id, concat_ws(' ', title, body) as body from i), d2 as (select id as doc_id, body from i), {_bm25_sql('d1', 's', 10, 'qs')}, {_bm25_sql('d2', 't', 10, 'qs')},
        r as (select qs.query_id, round(coalesce(1.0::double / s.rank, 0), 6) as a, round(coalesce(1.0::double / t.rank, 0), 6) as b from qs left join s on s.query_id = qs.query_id and s.doc_id = qs.query_id left join t on t.query_id = qs.query_id and t.doc_id = qs.query_id)
        select round(avg(a), 6) as mrr_with, round(avg(b), 6) as mrr_without, round(avg(a - b), 6) as gain, case when avg(a - b) < -0.05 then 'harmful' when avg(a - b) > 0.05 then 'helpful' else 'neutral' end as verdict from r""",
    "ref_backlog_counts": "select repo, count(*) as total, count(resolved) as resolved, count(error) as failed, count(*) filter (resolved is null and error is null) as pending from (select distinct * from forge_refs) group by 1",
    "refs_pending": "select repo, ref_number, discovered from (select distinct * from forge_refs) where resolved is null and error is null order by discovered desc, repo, ref_number limit 50",
    "refs_discovered": f"""with {PAYLOAD}, r as (select seq, json_extract_string(p, '$.sha') as sha, try_cast(json_extract_string(p, '$.parsed.pr_ref') as bigint) as n from pl where event_type = 'git.commit')
        select n as ref_number, (min(struct_pack(seq := seq, sha := sha))).sha as source from r where n is not null and sha is not null and n not in (select ref_number from forge_refs where ref_number is not null) group by 1""",
    "context_docs": "select id, title, layer from (select distinct * from patterns) where lower(layer) in ('core', 'surface') and (contains(lower(coalesce(id, '')), 'index') or contains(lower(coalesce(title, '')), 'index'))",
    "knowledge_latest": """with e as (select event_id as id, epoch_us(ts) as timestamp, user_id, event_type, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as supersedes from events where event_type in ('signup', 'purchase'))
        select id, user_id, timestamp from e where event_type = 'signup' and id not in (select supersedes from e where supersedes is not null) order by timestamp desc, id desc limit 50""",
    "spec_milestones": """with p as (select distinct id, layer, current_milestone as current from patterns where current_milestone is not null), v as (select distinct layer, current as version from p)
        select id as spec_id, min(version) as next_version from p join v using (layer) where version > current group by 1""",
}
