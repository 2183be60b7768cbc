"""SQL that splits packed fields by rules: quoted runs first, then all delimiters of the field's kind.

It knows what the fields of the tables may hold and chooses no dialect, so it stands on its own
beside the operator that does.
"""

from __future__ import annotations

_BLANK = r"[\s\p{Z}\x{feff}\x{200b}]"
_QUOTED = r""""(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.)*'"""
#: kind -> what a value without quotes can't hold.
_CUTS = {"labels": r"[^,;|，、•\n\r\t]+", "words": r"[^,;|，、•\n\r\t/ ]+"}


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _values(kind: str) -> str:
    if kind == "numbers":
        return r"regexp_extract_all(t, '\d+')"
    token = rf"{_BLANK}*(?:-{_BLANK}+)?(?:{_QUOTED})|{_CUTS[kind]}"
    inner = "case when regexp_matches(t, '^(?s:\\[.*\\]|\\{.*\\})$') then substr(t, 2, length(t) - 2) else t end"
    bare = f"regexp_replace({_trimmed('x')}, '^(?:-{_BLANK}+|#)+', '')"
    undone = "replace(replace(replace(substr(y, 2, length(y) - 2), '\\\"', '\"'), '\"\"', '\"'), '\\\\', '\\')"
    cleaned = f"list_transform(list_transform(regexp_extract_all({inner}, {_quote(token)}), lambda x: {bare}), lambda y: {_trimmed(f'''case when length(y) > 1 and left(y, 1) in ('\"', chr(39)) and right(y, 1) = left(y, 1) then {undone} else y end''')})"
    return f"case when lower(t) = 'n/a' then [] when left(t, 1) = '[' and json_valid(t) then list_transform(json_extract_string(t, '$[*]'), lambda x: {_trimmed('x')}) else {cleaned} end"


def found(fields: dict[str, tuple[str, str, str]]) -> str:
    """p1_found by rules; fields: table -> (key, column, kind)."""
    parts = " union all ".join(f"select tbl, record_id, {_values(kind)} as vs from (select '{t}' as tbl, {key}::varchar as record_id, {_trimmed(c)} as t from {t} where {c} is not null and {key} is not null)" for t, (key, c, kind) in fields.items())
    return f"""with p as ({parts}), k as (select distinct tbl, record_id, list_filter(vs, lambda x: x is not null and lower(x) not in ('', '-', 'null', 'none', 'n/a')) as vs from p)
        select distinct tbl, record_id, unnest(range(1, len(vs) + 1))::int as pos, unnest(vs) as value from k"""
