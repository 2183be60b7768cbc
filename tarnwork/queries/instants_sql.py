"""SQL that reads instants in one direct way: patterns, zone tables and calendar functions."""

from __future__ import annotations

from tarnwork.operators.instants import ZONES

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_REST = r"\s*(.*)$"
#: format -> pattern and names of its groups.
_FORMATS = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_TIME}{_REST}", "y mo d h mi s f z"),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T_-](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_REST}", "y mo d h mi s f z"),
    "slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_TIME}(?:\s*([AaPp])\.?[Mm]\.?)?{_REST}", "mo d y h mi s f half z"),
    "dot": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_TIME}(?:\s*([AaPp])\.?[Mm]\.?)?{_REST}", "d mo y h mi s f half z"),
    "mail": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}})\s+{_TIME}{_REST}", "d mon y h mi s f z"),
    "ctime": (rf"^[A-Za-z]{{3,9}}\s+([A-Za-z]{{3,9}})\s+(\d{{1,2}})\s+{_TIME}\s+(\d{{4}}){_REST}", "mon d h mi s f y z"),
    "day": (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "y mo d"),
}
_FIELDS = "y mo mon d h mi s f half z".split()
_NUMBER = r"(y, mo, d, h, mi, s)"


def _parts() -> str:
    selects = []
    for fmt, (pattern, names) in _FORMATS.items():
        names = names.split()
        quoted = pattern.replace("'", "''")
        took = f"regexp_extract(t, '{quoted}', [{', '.join(repr(n) for n in names)}])"
        columns = ", ".join(f"x.{n} as {n}" if n in names else f"'' as {n}" for n in _FIELDS)
        selects.append(f"select v, zone, '{fmt}' as fmt, {columns} from (select v, zone, {took} as x from em_t where regexp_matches(t, '{quoted}'))")
    return " union all ".join(selects)


def instants(rows: str) -> str:
    """CTEs up to em(v, zone, utc_us): the instant of every distinct (v, zone) of the CTE `rows`."""
    known = " ".join(f"when '{name}' then {minutes[0]}" for name, minutes in ZONES.items() if len(minutes) == 1)
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    return rf"""em_t as (select distinct v, zone, regexp_replace(v, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as t from {rows}),
        em_p as ({_parts()}),
        em_n as (select v, zone, fmt, z, upper(z) as zu, try_cast(y as int) as y, case when mon <> '' then list_position({months}, lower(left(mon, 3))) else try_cast(mo as int) end as mo, try_cast(d as int) as d,
            case when half = '' then coalesce(try_cast(h as int), 0) when try_cast(h as int) between 1 and 12 then try_cast(h as int) % 12 + case when lower(half) = 'p' then 12 else 0 end end as h,
            coalesce(try_cast(mi as int), 0) as mi, coalesce(try_cast(s as int), 0) as s, coalesce(try_cast(left(f || '000000', 6) as bigint), 0) as us from em_p),
        em_w as (select *, case when h <= 23 and mi <= 59 and s <= 59 then try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) as timestamp) end as wall,
            regexp_extract(z, '^(?:UTC|GMT)?([+−-])(\d{{2}}):?(\d{{2}})?(?:\s*\[.*\])?$', ['sign', 'hh', 'mm']) as o, regexp_extract(z, '^\[?([A-Za-z][\w+-]*/[\w/+-]+)\]?$', 1) as named from em_n where y > 0 and mo > 0 and d > 0),
        em_z as (select w.*, case when z = '' then zone when n.name is not null then n.name end as place from em_w w left join pg_timezone_names() n on n.name = w.named and w.named <> ''),
        em_l as (select *, case when place is not null then timezone(place, wall) end as late from em_z where wall is not null),
        em_e as (select v, zone, us + case when place is not null then epoch_us(case when timezone(place, late - interval 1 hour) = wall then late - interval 1 hour when timezone(place, late - interval 30 minute) = wall then late - interval 30 minute else late end)
            when z = '' then epoch_us(wall) when o.sign <> '' then epoch_us(wall) - case when o.sign = '+' then 1 else -1 end * (coalesce(try_cast(o.hh as int), 0) * 60 + coalesce(try_cast(o.mm as int), 0)) * 60000000::bigint
            else epoch_us(wall) - case zu {known} end * 60000000::bigint end as utc_us from em_l),
        em_u as (select v, zone, case when length(t) <= 11 then try_cast(t as hugeint) * 1000000 when length(t) <= 14 then try_cast(t as hugeint) * 1000 when length(t) <= 17 then try_cast(t as hugeint) else try_cast(t as hugeint) // 1000 end::bigint as utc_us from em_t where regexp_matches(t, '^\d{{1,20}}$')),
        em as (select v, zone, max(utc_us) as utc_us from (select * from em_e union all select * from em_u) where utc_us is not null group by 1, 2)"""


#: Names of repositories as p2 takes them from addresses and paths, and their zones.
ZONE_ROWS = "zn as (select distinct on (lower(trim(name))) lower(trim(name)) as repo_name, zone from repo_zones order by 1, 2)"


def repo_of_path(column: str) -> str:
    return rf"lower(coalesce(nullif(regexp_extract({column}, '^\s*https?://[^/]+/[^/]+/([^/?#]+)', 1), ''), regexp_extract({column}, '^\s*(?:\./|/)*([^/]+)', 1)))"


def repo_of_email(column: str) -> str:
    return rf"lower(regexp_extract({column}, '@([^@\s]+?)\.[A-Za-z]+\s*$', 1))"


def dated_commits(out: str = "oc") -> str:
    """CTEs up to out(sha, author_name, utc_us, day): every commit at the latest instant of its copies."""
    return f"""{ZONE_ROWS}, cz as (select sha, author_name, timestamp as v, coalesce(zone, 'UTC') as zone from commits left join zn on repo_name = {repo_of_email('author_email')}), {instants('cz')},
        {out} as (select sha, author_name, utc_us, (timestamp 'epoch' + to_microseconds(utc_us))::date as day from (select sha, max(author_name) as author_name, max(utc_us) as utc_us from cz left join em using (v, zone) group by 1))"""


P2_FOUND = f"""with {ZONE_ROWS}, ra as (select 'eventlog' as tbl, seq::varchar as record_id, timestamp as v, {repo_of_path('source_file')} as r from eventlog union all select 'commits', sha, timestamp, {repo_of_email('author_email')} from commits
        union all select 'forge_issues', number::varchar, created_at, {repo_of_path('url')} from forge_issues), rz as (select tbl, record_id, v, coalesce(zone, 'UTC') as zone from ra left join zn on repo_name = r where record_id is not null), {instants('rz')}
    select distinct tbl, record_id, utc_us from rz join em using (v, zone)"""
