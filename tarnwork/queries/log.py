"""Queries over the event log: scans, latest state, feedback views, session links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import eventlog, feedback, intervals
from tarnwork.plans.shaping import table

# The payload as text, in DuckDB's words; see operators.eventlog.payload.
PAYLOAD = """
    ev as (select seq, event_type, timestamp, source_id, case when json_valid(data) then data end as d from eventlog),
    op as (select *, case when json_type(d) = 'VARCHAR' then json_extract_string(d, '$') else d end as o from ev),
    pl as (select *, case when json_valid(o) and json_extract(o, '$.v') is not null and json_extract(o, '$.payload') is not null then json_extract_string(o, '$.payload') else o end as p from op)"""


def _items(x: str) -> str:
    return f"unnest(json_extract(case when json_type({x}) = 'OBJECT' then '[' || {x} || ']' else {x} end, '$[*]'))"


ITEMS = _items("x")
QUERY_ROWS = """
    q as (select seq, json_extract_string(p, '$.session_id') as session_id, json_extract_string(p, '$.query_id') as query_id, json_extract_string(p, '$.query') as query,
                 json_extract_string(p, '$.mode') as mode, json_extract_string(p, '$.results') as x from pl where event_type = 'scry.query')"""
HITS = f"""with {PAYLOAD}, {QUERY_ROWS},
    r as (select seq, session_id, query_id, query, mode, {ITEMS} as item from q where session_id is not null and json_valid(x)),
    res as (select seq, session_id, query_id, query, mode, json_extract_string(item, '$.doc_id') as doc_id, try_cast(json_extract_string(item, '$.rank') as bigint) as rank,
                   try_cast(json_extract_string(item, '$.score') as double) as score from r where json_extract_string(item, '$.doc_id') is not null),
    c as (select seq, json_extract_string(p, '$.sha') as sha, json_extract_string(p, '$.session_id') as session_id, json_extract_string(p, '$.files') as x from pl where event_type = 'git.commit'),
    cl as (select sha, max(struct_pack(seq := seq, session_id := session_id, x := x)) as r from c where sha is not null and session_id is not null group by sha),
    ci as (select sha, r.session_id as session_id, {_items("r.x")} as item from cl where json_valid(r.x)),
    cf as (select distinct session_id, sha, json_extract_string(item, '$.path') as file_path, coalesce(json_extract_string(item, '$.change_type'), json_extract_string(item, '$.changeType')) as change_type
           from ci where json_extract_string(item, '$.path') is not null),
    hit as (select distinct res.session_id, res.doc_id from res join cf on cf.session_id = res.session_id and contains(cf.file_path, res.doc_id)),
    h as (select res.*, case when hit.doc_id is null then 0 else 1 end::bigint as is_hit from res left join hit on hit.session_id = res.session_id and hit.doc_id = res.doc_id)
"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eventlog")


def event_family_counts(spark, d):
    return _log(spark, d).agg(*(F.count_if(F.col("event_type").startswith(f"{x}.")).alias(f"n_{x}") for x in ("code", "git", "session", "forge", "scry", "belief")), F.count(F.lit(1)).alias("n_all"))


def events_by_type(spark, d):
    log = eventlog.scan(_log(spark, d), types=["session.decision", "session.observation", "session.goal"])
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("n_sources"), F.max("seq").alias("last_seq"))


def invalid_payloads(spark, d):
    return _log(spark, d).where(~eventlog.is_json(F.col("data"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def latest_event_per_source(spark, d):
    rows = _log(spark, d).select("event_type", "source_id", "seq", "timestamp")
    return eventlog.latest(rows, ["event_type", "source_id"], ["seq"])


def feedback_session_queries(spark, d):
    return feedback.session_queries(_log(spark, d)).select("seq", "session_id", "query_id", "query", "mode")


def feedback_usage(spark, d):
    return feedback.usage(_log(spark, d)).select("seq", "query_id", "doc_id", "rank", "session_id")


def feedback_ratings(spark, d):
    return feedback.ratings(_log(spark, d)).select("seq", "query_id", "signal", "comment", "session_id")


def feedback_commit_files(spark, d):
    return feedback.commit_files(_log(spark, d))


def feedback_commit_files_compat(spark, d):
    return feedback.commit_files(_log(spark, d), one_row_per_commit=True)


def feedback_query_hits(spark, d):
    return feedback.query_hits(_log(spark, d))


def feedback_query_analysis(spark, d):
    return feedback.query_analysis(_log(spark, d))


def feedback_precision(spark, d):
    return feedback.precision(feedback.query_hits(_log(spark, d)))


def feedback_precision_by_rank(spark, d):
    return feedback.precision(feedback.query_hits(_log(spark, d)), "rank")


def feedback_top_sessions(spark, d):
    return feedback.precision(feedback.query_hits(_log(spark, d)), "session_id").orderBy(F.desc("n_hits"), F.desc("n_results"), "session_id").limit(5)


def feedback_high_value_docs(spark, d):
    hits = feedback.query_hits(_log(spark, d)).where("is_hit = 1")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("query").alias("n_queries")).orderBy(F.desc("n_hits"), "doc_id").limit(10)


def query_result_detail(spark, d):
    """Open the second result of the last logged query that has one."""
    found = feedback.results(_log(spark, d)).where("rank = 2")
    return found.orderBy(F.desc("seq"), "doc_id").limit(1).select("seq", "query_id", "doc_id", "score")


def session_commit_link(spark, d):
    """Each purchase belongs to the user's latest sign-up before it, open for 24 hours at most."""
    ev = table(spark, d, "events")
    starts = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session"), F.col("ts").alias("begin"), (F.col("ts") + F.expr("interval 24 hours")).alias("end"))
    points = ev.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return intervals.latest_match(points, starts, ["user_id"], "ts", "begin", "end", "event_id", "session", width_s=86_400).select("event_id", "user_id", "session")


QUERIES = {
    f.__name__: f
    for f in (
        event_family_counts, events_by_type, invalid_payloads, latest_event_per_source, feedback_session_queries, feedback_usage, feedback_ratings, feedback_commit_files, feedback_commit_files_compat,
        feedback_query_hits, feedback_query_analysis, feedback_precision, feedback_precision_by_rank, feedback_top_sessions, feedback_high_value_docs, query_result_detail, session_commit_link,
    )
}

SQL = {
    "event_family_counts": "select " + ", ".join(f"count(*) filter (event_type like '{x}.%') as n_{x}" for x in ("code", "git", "session", "forge", "scry", "belief")) + ", count(*) as n_all from eventlog",
    "events_by_type": "select event_type, count(*) as n, count(distinct source_id) as n_sources, max(seq) as last_seq from eventlog where event_type in ('session.decision', 'session.observation', 'session.goal') group by 1",
    "invalid_payloads": "select event_type, count(*) as n from eventlog where not json_valid(data) group by 1",
    "latest_event_per_source": "select event_type, source_id, seq, timestamp from (select distinct on (event_type, source_id) event_type, source_id, seq, timestamp from eventlog order by event_type, source_id, seq desc, timestamp desc nulls last)",
    "feedback_session_queries": f"with {PAYLOAD}, {QUERY_ROWS} select seq, session_id, query_id, query, mode from q where session_id is not null",
    "feedback_usage": f"""with {PAYLOAD} select seq, json_extract_string(p, '$.query_id') as query_id, json_extract_string(p, '$.result_used') as doc_id,
        try_cast(json_extract_string(p, '$.rank') as bigint) as rank, json_extract_string(p, '$.session_id') as session_id from pl where event_type = 'scry.use'""",
    "feedback_ratings": f"""with {PAYLOAD} select seq, json_extract_string(p, '$.query_id') as query_id, json_extract_string(p, '$.signal') as signal,
        json_extract_string(p, '$.comment') as comment, json_extract_string(p, '$.session_id') as session_id from pl where event_type = 'scry.feedback'""",
    "feedback_commit_files": HITS + "select session_id, sha, file_path, change_type from cf",
    "feedback_commit_files_compat": f"""with {PAYLOAD},
        c as (select seq, json_extract_string(p, '$.sha') as sha, json_extract_string(p, '$.session_id') as session_id, json_extract_string(p, '$.files') as x from pl where event_type = 'git.commit'),
        i as (select seq, sha, session_id, {ITEMS} as item from c where sha is not null and session_id is not null and json_valid(x)),
        f as (select seq, sha, session_id, json_extract_string(item, '$.path') as file_path, coalesce(json_extract_string(item, '$.change_type'), json_extract_string(item, '$.changeType')) as change_type from i)
        select session_id, sha, file_path, change_type from (select *, row_number() over (partition by sha order by seq desc, file_path, change_type nulls first) as rn from f where file_path is not null) where rn = 1""",
    "feedback_query_hits": HITS + "select session_id, doc_id, seq, query_id, query, mode, rank, score, is_hit from h",
    "feedback_query_analysis": f"""with {PAYLOAD}, {QUERY_ROWS},
        u as (select json_extract_string(p, '$.query_id') as query_id, try_cast(json_extract_string(p, '$.rank') as bigint) as rank from pl where event_type = 'scry.use'),
        ua as (select query_id, count(*) as use_count, string_agg(rank::varchar, ',' order by rank) as used_ranks from u where query_id is not null group by 1),
        f as (select seq, json_extract_string(p, '$.query_id') as query_id, json_extract_string(p, '$.signal') as signal from pl where event_type = 'scry.feedback'),
        fa as (select query_id, arg_min(signal, seq) as feedback_signal from f where query_id is not null group by 1)
        select q.seq, q.session_id, q.query_id, q.query, q.mode, coalesce(use_count, 0) as use_count, coalesce(used_ranks, '') as used_ranks, feedback_signal
        from q left join ua using (query_id) left join fa using (query_id)""",
    "feedback_precision": HITS + "select count(*) as n_results, sum(is_hit)::bigint as n_hits, round(sum(is_hit) / count(*), 6) as hit_rate from h",
    "feedback_precision_by_rank": HITS + "select rank, count(*) as n_results, sum(is_hit)::bigint as n_hits, round(sum(is_hit) / count(*), 6) as hit_rate from h group by 1",
    "feedback_top_sessions": HITS + "select session_id, count(*) as n_results, sum(is_hit)::bigint as n_hits, round(sum(is_hit) / count(*), 6) as hit_rate from h group by 1 order by 3 desc, 2 desc, 1 limit 5",
    "feedback_high_value_docs": HITS + "select doc_id, count(*) as n_hits, count(distinct query) as n_queries from h where is_hit = 1 group by 1 order by 2 desc, 1 limit 10",
    "query_result_detail": HITS + "select seq, query_id, doc_id, score from res where rank = 2 order by seq desc, doc_id limit 1",
    "session_commit_link": """select p.event_id, p.user_id, s.event_id as session from events p join events s on p.user_id = s.user_id and s.event_type = 'signup'
        and s.ts <= p.ts and p.ts <= s.ts + interval 24 hours where p.event_type = 'purchase' qualify row_number() over (partition by p.event_id order by s.ts desc, s.event_id desc) = 1""",
}
