"""Queries of the general data problems: packed fields, instants, nested records, orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import instants, nested, orphans, packed
from tarnwork.plans.shaping import checkpoint, table
from tarnwork.queries import instants_sql, packed_sql

PACKED_FIELDS = {"forge_issues": ("number", "labels", "labels"), "beliefs": ("id", "facets", "words"), "patterns": ("id", "tags", "words"), "forge_prs": ("number", "linked_issues", "numbers")}


def _packed(spark: SparkSession, d: str) -> DataFrame:
    rows = [table(spark, d, t).select(F.lit(t).alias("field"), F.col(key).cast("string").alias("record_id"), F.col(c).alias("text")) for t, (key, c, _) in PACKED_FIELDS.items()]
    return packed.split_packed(reduce(DataFrame.unionByName, rows), {t: kind for t, (_, _, kind) in PACKED_FIELDS.items()})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(F.col("field").alias("tbl"), "record_id", "pos", "value").distinct()


def p1_dialects(spark: SparkSession, d: str) -> DataFrame:
    """How many records and values each field's dialects explain."""
    return _packed(spark, d).distinct().groupBy(F.col("field").alias("tbl"), "dialect").agg(F.count_distinct("record_id").alias("records"), F.count(F.lit(1)).alias("n_values"))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    """tbl, record_id, utc_us, fmt, posterior, ambiguous, source of all timestamps."""
    parts = [("eventlog", "seq", "timestamp", "source_file", "path"), ("commits", "sha", "timestamp", "author_email", "email"), ("forge_issues", "number", "created_at", "url", "path")]
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("record_id"), F.col(v).alias("value"), instants.repository_name(kind, F.col(s)).alias("repo")) for t, k, v, s, kind in parts]
    named = instants.with_zone(reduce(DataFrame.unionByName, rows), F.col("repo"), table(spark, d, "repo_zones"))
    named = named.withColumn("source", F.concat_ws(":", "tbl", F.coalesce("zone", F.lit("UTC"))))
    return instants.normalise_instants(named, "value", "zone", "source", instants.MONTH_FIRST_SLASH_DAY_FIRST_DOT)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where(F.col("utc_us").isNotNull() & F.col("record_id").isNotNull()).select("tbl", "record_id", "utc_us").distinct()


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """Format mixture of every source, with unread and ambiguous values counted apart."""
    n = _instants(spark, d)
    return n.groupBy("source", F.coalesce("fmt", F.lit("none")).alias("fmt")).agg(F.count(F.lit(1)).alias("n_values"), F.count_if("ambiguous").alias("n_ambiguous"), F.round(F.min("posterior"), 6).alias("least_posterior"))


def _nested_rows(spark: SparkSession, d: str) -> DataFrame:
    return nested.pivot_rows(nested.to_triples(table(spark, d, "eventlog"), "seq", "data"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _nested_rows(spark, d).select(F.col("rec").alias("seq"), "path", "pos")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of files, with the link of each row to its parent."""
    return nested.one_table(_nested_rows(spark, d), "files", ["path", "change_type", "lines_added", "lines_removed"])


REPO_OF_URL = r"^\s*https?://[^/]+/([^/]+/[^/?#]+)"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, record_id, repo, number, event_seq, linked, source, period) of issues, pull requests and
    resolved backlog entries; one mixture of time formats is fitted for each table and repository."""
    parts = []
    for t in ("forge_issues", "forge_prs"):
        linked = F.col("linked_issues") if t == "forge_prs" else F.lit(None).cast("string")
        parts.append(table(spark, d, t).select(F.lit(t).alias("tbl"), F.col("number").cast("string").alias("record_id"), F.regexp_extract("url", REPO_OF_URL, 1).alias("repo"), "number", "event_seq", linked.alias("linked"), F.lit(None).cast("string").alias("source"), F.col("created_at").alias("at"), instants.repository_name("path", F.col("url")).alias("zoned")))
    refs = table(spark, d, "forge_refs").where(F.col("resolved").isNotNull())
    # resolved is written with its zone
    parts.append(refs.select(F.lit("forge_refs").alias("tbl"), F.col("repo").alias("record_id"), "repo", F.col("ref_number").alias("number"), F.lit(None).cast("bigint").alias("event_seq"), F.lit(None).cast("string").alias("linked"), "source", F.col("resolved").alias("at"), F.lit("").alias("zoned")))
    rows = instants.with_zone(reduce(DataFrame.unionByName, parts).distinct(), F.col("zoned"), table(spark, d, "repo_zones"))
    read = instants.normalise_instants(rows.withColumn("mixture", F.concat_ws(":", "tbl", "repo")), "at", "zone", "mixture", instants.MONTH_FIRST_SLASH_DAY_FIRST_DOT)
    return checkpoint(read.select("tbl", "record_id", "repo", "number", "event_seq", "linked", "source", orphans.month(F.col("utc_us")).alias("period")))


def _references(spark: SparkSession, d: str, dated: DataFrame) -> list[orphans.Reference]:
    """The references that p6_found is about."""
    text = lambda c: F.col(c).cast("string").alias("ref")
    log = table(spark, d, "eventlog").where(F.col("event_type").isin("forge.issue", "forge.pr")).select(F.col("seq").alias("event_seq"), F.col("source_id").alias("record_id"))
    found = [orphans.Reference(t, dated.where(F.col("tbl") == t).select("record_id", "event_seq", text("event_seq"), "period"), "eventlog", log, ["event_seq", "record_id"]) for t in ("forge_issues", "forge_prs")]
    entries, fetched = dated.where("tbl = 'forge_refs'"), dated.where("tbl != 'forge_refs'").select("repo", "number")
    found.append(orphans.Reference("forge_refs", entries.select("repo", "number", "record_id", text("number"), "period"), "forge", fetched, ["repo", "number"]))
    belief_key = F.lower(F.regexp_replace("belief_id", r"^[\s ﻿　]+|[\s ﻿　]+$", ""))
    reach = table(spark, d, "belief_code_reach").select(belief_key.alias("belief"), belief_key.alias("ref"), F.col("file_path").alias("record_id"), F.lit("none").alias("period"))
    beliefs = table(spark, d, "beliefs").where(F.coalesce("status", F.lit("")) != "deleted").select(F.col("id").alias("belief_id")).select(belief_key.alias("belief"))
    found.append(orphans.Reference("belief_code_reach", reach, "beliefs", beliefs, ["belief"]))
    return found


def _links(dated: DataFrame) -> DataFrame:
    """(record_id, number, ref, period): the issues that pull requests are linked to."""
    numbers = F.explode(F.array_distinct(F.regexp_extract_all("linked", F.lit(r"(\d{1,18})"), 1))).alias("ref")
    return dated.where("tbl = 'forge_prs'").select("record_id", "period", numbers).withColumn("number", F.col("ref").cast("bigint"))


def _edges(dated: DataFrame, linked: bool) -> DataFrame:
    """References to issues and pull requests that exist, down which orphans are inherited."""
    entries = dated.where("tbl = 'forge_refs'").select(F.lit("forge_refs").alias("tbl"), "record_id", F.col("number").cast("string").alias("ref"), "period", "repo", "number")
    keys = dated.where("tbl != 'forge_refs'").select(F.col("tbl").alias("up_tbl"), "repo", "number").distinct()
    edges = entries.join(keys, ["repo", "number"]).select("tbl", "record_id", "ref", "period", "up_tbl", F.col("ref").alias("up_id"))
    if linked:
        issues = dated.where("tbl = 'forge_issues'").select("number").distinct()
        edges = edges.unionByName(_links(dated).join(issues, "number").select(F.lit("forge_prs").alias("tbl"), "record_id", "ref", "period", F.lit("forge_issues").alias("up_tbl"), F.col("ref").alias("up_id")))
    return edges


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    dated = _dated(spark, d)
    found = orphans.cascade(orphans.direct_orphans(_references(spark, d, dated)), _edges(dated, linked=False))
    return found.where("kind = 'direct'").select("tbl", "record_id", "ref", "period").distinct()


def p6_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, target and month. Beyond p6_found's references pull
    requests refer to the issues they are linked to and backlog entries to their source commit,
    so that an issue without its event is inherited by pull requests, and by the entries of those."""
    dated = _dated(spark, d)
    refs = _references(spark, d, dated)
    issues = dated.where("tbl = 'forge_issues'").select("number")
    refs.append(orphans.Reference("forge_prs", _links(dated), "forge_issues", issues, ["number"]))
    entries = dated.where("tbl = 'forge_refs'").select("record_id", F.col("source").alias("sha"), F.col("source").alias("ref"), "period")
    refs.append(orphans.Reference("forge_refs", entries, "commits", table(spark, d, "commits").select("sha"), ["sha"]))
    found = orphans.cascade(orphans.direct_orphans(refs), _edges(dated, linked=True))
    return found.groupBy("tbl", "target", "period", "kind", "depth").agg(F.count(F.lit(1)).alias("n_refs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_dialects, p2_found, p2_sources, p5_found, p5_files, p6_found, p6_cascade)}
_NAMES = ", ".join(f"'{x}'" for x in nested.REPEATED)

P5 = f"""
        with recursive dec as (select distinct seq, data from eventlog where seq is not null and json_valid(data)),
         w(seq, v, path, pos, state) as (
           select seq, case when json_type(data) = 'VARCHAR' and json_valid(json_extract_string(data, '$')) then json_extract_string(data, '$') else data end, '', '', '' from dec
           union all
           select seq, case when c.type = 'VARCHAR' and json_valid(json_extract_string(c.value, '$')) and json_type(json_extract_string(c.value, '$')) in ('OBJECT', 'ARRAY') then json_extract_string(c.value, '$') else c.value::varchar end,
             case when t = 'OBJECT' and c.key in ({_NAMES}) then case when x.path = '' then c.key else x.path || '.' || c.key end else x.path end,
             case when t = 'ARRAY' then case when p = '' then c.key else p || '.' || c.key end else p end,
             case when t = 'OBJECT' then case when c.key in ({_NAMES}) then 'open' else '' end when state = '' then '' else 'item' end
           from (select *, json_type(v) as t, case when state = 'open' and json_type(v) = 'OBJECT' then case when pos = '' then '0' else pos || '.0' end else pos end as p from w where json_type(v) in ('OBJECT', 'ARRAY')) x, json_each(x.v) c
           where c.type in ('OBJECT', 'ARRAY') or (c.type = 'VARCHAR' and json_valid(json_extract_string(c.value, '$')) and json_type(json_extract_string(c.value, '$')) in ('OBJECT', 'ARRAY'))),
         o as (select seq, v, path, case when state = 'open' then case when pos = '' then '0' else pos || '.0' end else pos end as place from w where state <> '' and json_type(v) = 'OBJECT')
        """
_REPO = r"regexp_extract(url, '^\s*https?://[^/]+/([^/]+/[^/?#]+)', 1)"
_KEY = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
P6 = f"""with {instants_sql.ZONE_ROWS}, dr as (select 'forge_issues' as tbl, number::varchar as record_id, {_REPO} as repo, number, event_seq, null as linked, null as source, created_at as v, {instants_sql.repo_of_path('url')} as r from forge_issues
        union all select 'forge_prs', number::varchar, {_REPO}, number, event_seq, linked_issues, null, created_at, {instants_sql.repo_of_path('url')} from forge_prs
        union all select 'forge_refs', repo, repo, ref_number, null, null, source, resolved, '' from forge_refs where resolved is not null),
        dz as (select dr.*, coalesce(zone, 'UTC') as zone from dr left join zn on repo_name = r), {instants_sql.instants('dz')},
        dt as (select distinct tbl, record_id, repo, number, event_seq, linked, source, coalesce(strftime(timestamp 'epoch' + to_microseconds(utc_us), '%Y-%m'), 'unknown') as period from dz left join em on em.v = dz.v and em.zone = dz.zone),
        lg as (select distinct seq, source_id from eventlog where event_type in ('forge.issue', 'forge.pr') and seq is not null and source_id is not null), ft as (select distinct repo, number from dt where tbl <> 'forge_refs'),
        ln as (select distinct record_id, period, ref, ref::bigint as n from (select record_id, period, unnest(regexp_extract_all(linked, '\\d+')) as ref from dt where tbl = 'forge_prs')),
        """
P6_GIVEN = f"""select tbl, record_id, event_seq::varchar as ref, period, 'eventlog' as target from dt anti join lg on seq = event_seq and source_id = record_id where tbl <> 'forge_refs' and event_seq is not null
        union all select tbl, record_id, number::varchar, period, 'forge' from dt anti join ft using (repo, number) where tbl = 'forge_refs' and number is not null
        union all select 'belief_code_reach', file_path, {_KEY.format('belief_id')}, 'none', 'beliefs' from belief_code_reach where belief_id is not null and {_KEY.format('belief_id')} not in (select {_KEY.format('id')} from beliefs where id is not null and coalesce(status, '') <> 'deleted')"""
P6_MORE = """select 'forge_prs', record_id, ref, period, 'forge_issues' from ln where n not in (select number from dt where tbl = 'forge_issues' and number is not null) union all select 'forge_refs', record_id, source, period, 'commits' from dt where tbl = 'forge_refs' and source is not null and source not in (select sha from commits where sha is not null)"""

SQL = {
    "p1_found": packed_sql.found(PACKED_FIELDS),
    "p2_found": instants_sql.P2_FOUND,
    "p5_found": P5 + "select distinct seq, path, place as pos from o",
    "p5_files": P5 + ", ".join(["select distinct seq as rec, place as pos, '' as parent_path, '' as parent_pos", *(f"case when json_type(v, '$.{c}') not in ('OBJECT', 'ARRAY') then json_extract_string(v, '$.{c}') end as {c}" for c in ("path", "change_type", "lines_added", "lines_removed"))]) + " from o where o.path = 'files'",
    "p6_found": P6.rstrip().removesuffix(",") + f" select distinct tbl, record_id, ref, period from ({P6_GIVEN})",
    "p6_cascade": P6 + f"""d0 as (select distinct * from ({P6_GIVEN} union all {P6_MORE})),
        lk as (select distinct 'forge_prs' as tbl, record_id, ref, period, 'forge_issues' as target, ref as up from ln where n in (select number from dt where tbl = 'forge_issues' and number is not null)),
        rf as (select distinct 'forge_refs' as tbl, r.record_id, r.number::varchar as ref, r.period, u.tbl as target, r.number::varchar as up from dt r join dt u on u.repo = r.repo and u.number = r.number and u.tbl <> 'forge_refs' where r.tbl = 'forge_refs'),
        d1 as (select lk.* from lk where up in (select record_id from d0 where tbl = 'forge_issues') union all select rf.* from rf where (target, up) in (select tbl, record_id from d0)),
        d2 as (select rf.* from rf where target = 'forge_prs' and up in (select record_id from d1 where tbl = 'forge_prs') and (record_id, ref, target) not in (select record_id, ref, target from d1 where tbl = 'forge_refs')),
        al as (select tbl, record_id, ref, period, target, 'direct' as kind, 0 as depth from d0 union all select tbl, record_id, ref, period, target, 'inherited', 1 from d1 anti join d0 using (tbl, record_id, ref, target)
            union all select tbl, record_id, ref, period, target, 'inherited', 2 from d2)
        select tbl, target, period, kind, depth, count(*) as n_refs from al group by all""",
}
