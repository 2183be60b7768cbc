"""Mixed timestamp formats and zones: expectation-maximisation over format mixtures.

Every text is read under all formats that admit it; each reading gives one UTC instant.
Texts with the same set of readings form a signature; a source (a table and repository)
is a mixture of formats, estimated from the counts of its signatures: a signature spreads
its count over its formats in proportion to the mixture weight times the likelihood of
the instant, and the weights follow from those shares. The reading with the largest
posterior is taken; where its posterior stays under RESOLVED and another reading means
another instant, the row is marked ambiguous instead of silently trusted.

Declared conventions (slashes: month first; dots: day first) are priors: with weight 0 a
reading does not exist, with a small weight the data may overrule it.

Results for edge cases: NULL, empty and unreadable texts and impossible dates (the 30th of
February, hour 25) have no reading and utc_us NULL; fractions finer than microseconds are
cut; a local time that occurs twice means the earlier instant, a skipped one moves on by
the gap; a NULL or unknown zone is UTC; repeated rows stay repeated; extra columns pass
through, but for those named like a result (utc_us, fmt, posterior, ambiguous), which are
replaced, and names that begin with ``_em_``, which are reserved; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.shaping import checkpoint, join_checked

RESOLVED = 0.9
#: Readings outside these years are possible but very unlikely.
PLAUSIBLE_US = (datetime(1990, 1, 1).toordinal(), datetime(2100, 1, 1).toordinal())
#: Formats that a convention rules out have weight 0.
MONTH_FIRST_SLASH_DAY_FIRST_DOT = {"slash_dmy": 0.0, "dot_mdy": 0.0}

# English month names and the usual meanings of zone abbreviations, minutes east of UTC.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
ZONES = {
    "Z": (0,), "UTC": (0,), "GMT": (0,), "WET": (0,), "WEST": (60,), "CET": (60,), "CEST": (120,), "EET": (120,), "EEST": (180,), "MSK": (180,),
    "EST": (-300,), "EDT": (-240,), "CDT": (-300,), "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,), "JST": (540,), "KST": (540,),
    "AEST": (600,), "AEDT": (660,), "ACST": (570,), "ACDT": (630,), "AWST": (480,), "NZST": (720,), "NZDT": (780,), "NPT": (345,), "HKT": (480,), "SGT": (480,),
    "IST": (330, 60, 120), "BST": (60, 360), "CST": (-360, 480),
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?:\s*(?P<off>(?:UTC|GMT)?[+\-−]\d{2}(?::?\d{2})?)(?:\s*\[(?P<br>[\w/+\-]+)\])?|\s*\[(?P<only>[\w/+\-]+)\]|\s*(?P<name>[A-Za-z][\w/+\-]*))?"
_ISO = re.compile(rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_TIME}{_ZONE}$", re.A)
_DAY = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})$", re.A)
_COMPACT = re.compile(rf"(\d{{4}})(\d{{2}})(\d{{2}})[T\-_](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", re.A)
_PAIR = re.compile(rf"(\d{{1,2}})([/.])(\d{{1,2}})\2(\d{{4}})(?:,?\s+{_TIME}(?:\s*([AaPp])\.?[Mm]\.?)?{_ZONE})?$", re.A)
_MAIL = re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}})\s+{_TIME}{_ZONE}$", re.A)
_CTIME = re.compile(rf"[A-Za-z]{{3,9}}\s+([A-Za-z]{{3,9}})\s+(\d{{1,2}})\s+{_TIME}\s+(\d{{4}}){_ZONE}$", re.A)
_CTIME_ZONE_FIRST = re.compile(rf"[A-Za-z]{{3,9}}\s+([A-Za-z]{{3,9}})\s+(\d{{1,2}})\s+{_TIME}\s+([A-Z]{{2,5}})\s+(\d{{4}})$", re.A)
_EPOCH = re.compile(r"(\d{1,20})(?:\.(\d+))?$", re.A)
_DAY_US = 86_400_000_000
_EPOCH_DAY = date(1970, 1, 1).toordinal()


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (ValueError, OSError, KeyError):
        return None


def _wall(y: int, mo: int, d: int, h: int, mi: int, s: int, fraction: str | None) -> int | None:
    """Microseconds since 1970 of a wall clock reading; None if there is no such reading."""
    if h > 23 or mi > 59 or s > 59:
        return None
    try:
        day = date(y, mo, d).toordinal() - _EPOCH_DAY
    except ValueError:
        return None
    return day * _DAY_US + ((h * 60 + mi) * 60 + s) * 1_000_000 + int(((fraction or "") + "000000")[:6])


def _local(wall: int, zone: ZoneInfo | None) -> int:
    """UTC of a wall clock reading; fold 0 takes the earlier of two and moves on over a gap."""
    if zone is None:
        return wall
    days, rest = divmod(wall, _DAY_US)
    moment = datetime.fromordinal(days + _EPOCH_DAY).replace(hour=rest // 3_600_000_000, minute=rest // 60_000_000 % 60, second=rest // 1_000_000 % 60, tzinfo=zone)
    offset = moment.utcoffset()
    return wall - (offset.days * 86_400 + offset.seconds) * 1_000_000


def _offset(text: str) -> int | None:
    text = text.replace("−", "-")
    if text[:3] in ("UTC", "GMT"):
        text = text[3:]
    digits = text[1:].replace(":", "")
    h, m = int(digits[:2]), int(digits[2:4] or 0)
    return None if h > 18 or m > 59 else (h * 60 + m) * (-1 if text[0] == "-" else 1)


def _zoned(fmt: str, wall: int | None, m: re.Match, zone: ZoneInfo | None) -> list[tuple[str, int]]:
    if wall is None:
        return []
    if off := m["off"]:
        minutes = _offset(off)
        return [] if minutes is None else [(fmt, wall - minutes * 60_000_000)]
    name = m["only"] or m["name"]
    if not name:
        return [(fmt + "/local", _local(wall, zone))]
    if (minutes_of := ZONES.get(name.upper())) is not None:
        if len(minutes_of) == 1:
            return [(fmt, wall - minutes_of[0] * 60_000_000)]
        return [(f"{fmt}/{name.upper()}{x:+d}", wall - x * 60_000_000) for x in minutes_of]
    named = _zone(name)
    return [] if named is None else [(fmt, _local(wall, named))]


def readings(text: str | None, zone_name: str | None) -> list[tuple[str, int]]:
    """All (format, utc_us) under which a text denotes an instant."""
    if text is None:
        return []
    text = text.strip()
    if not text or not any(c.isdigit() for c in text):
        return []
    zone = _zone(zone_name)
    if m := _ISO.match(text):
        return _zoned("iso", _wall(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), int(m[6] or 0), m[7]), m, zone)
    if m := _EPOCH.match(text):
        digits = m[1]
        found = []
        for fmt, per_second in (("epoch_s", 1), ("epoch_ms", 10**3), ("epoch_us", 10**6), ("epoch_ns", 10**9)):
            us = int(digits) * 10**6 // per_second if not m[2] else int(digits + (m[2] + "0" * 6)[:6]) // per_second
            if 0 <= us // _DAY_US + _EPOCH_DAY < 3_652_059:
                found.append((fmt, us))
        return found
    if m := _COMPACT.match(text):
        return _zoned("compact", _wall(*(int(m[i]) for i in range(1, 7)), m[7]), m, zone)
    if m := _PAIR.match(text):
        a, b, y = int(m[1]), int(m[3]), int(m[4])
        h, mi, s = int(m[5] or 0), int(m[6] or 0), int(m[7] or 0)
        if half := m[9]:
            if not 1 <= h <= 12:
                return []
            h = h % 12 + (12 if half in "pP" else 0)
        name, other = ("slash", "dot")[m[2] == "."], []
        for fmt, mo, d in ((name + "_mdy", a, b), (name + "_dmy", b, a)):
            other += _zoned(fmt, _wall(y, mo, d, h, mi, s, m[8]), m, zone)
        return other
    if m := _MAIL.match(text):
        mo = MONTHS.get(m[2][:3].lower())
        return _zoned("mail", mo and _wall(int(m[3]), mo, int(m[1]), int(m[4]), int(m[5]), int(m[6] or 0), m[7]), m, zone) if mo else []
    if m := _CTIME.match(text):
        mo = MONTHS.get(m[1][:3].lower())
        return _zoned("ctime", _wall(int(m[7]), mo, int(m[2]), int(m[3]), int(m[4]), int(m[5] or 0), m[6]), m, zone) if mo else []
    if m := _CTIME_ZONE_FIRST.match(text):
        mo, minutes = MONTHS.get(m[1][:3].lower()), ZONES.get(m[7])
        wall = _wall(int(m[8]), mo, int(m[2]), int(m[3]), int(m[4]), int(m[5] or 0), m[6]) if mo else None
        return [(f"ctime/{m[7]}{x:+d}" if len(minutes) > 1 else "ctime", wall - x * 60_000_000) for x in minutes or ()] if wall is not None else []
    if m := _DAY.match(text):
        wall = _wall(int(m[1]), int(m[2]), int(m[3]), 0, 0, 0, None)
        return [] if wall is None else [("day/local", _local(wall, zone))]
    return []


_READINGS = "array<struct<fmt:string,utc_us:bigint>>"


def readings_column(value: Column, zone: Column, weights: dict[str, float]) -> Column:
    """Readings of a text, most plausible dates first in the signature; weight-0 formats left out."""

    @F.pandas_udf(_READINGS)
    def read(values: pd.Series, zones: pd.Series) -> pd.Series:
        out = []
        for text, zone_name in zip(values, zones, strict=True):
            text = None if text is None or text != text else text
            got = readings(text, zone_name)
            out.append([{"fmt": f, "utc_us": u} for f, u in got if weights.get(f.split("/")[0], 1.0) > 0])
        return pd.Series(out, dtype=object)

    return read(value, zone)


def _likely(utc_us: Column) -> Column:
    day = F.floor(utc_us / F.lit(_DAY_US)) + _EPOCH_DAY
    return (day >= PLAUSIBLE_US[0]) & (day < PLAUSIBLE_US[1])


def fit_mixture(counts: list[tuple[tuple[tuple[str, bool], ...], int]], weights: dict[str, float], rounds: int = 60) -> dict:
    """EM over one source. counts: (signature, number of texts). Returns signature -> (best place, posterior)."""
    formats = sorted({f for sig, _ in counts for f, _ in sig})
    prior = {f: weights.get(f.split("/")[0], 1.0) for f in formats}
    total = sum(prior.values()) or 1.0
    pi = {f: prior[f] / total for f in formats}

    def shares(sig: tuple[tuple[str, bool], ...]) -> list[float]:
        raw = [pi[f] * (1.0 if likely else 1e-9) for f, likely in sig]
        s = sum(raw)
        return [x / s for x in raw] if s > 0 else [1.0 / len(sig)] * len(sig)

    for _ in range(rounds):
        new = {f: 0.05 * prior[f] for f in formats}
        for sig, n in counts:
            for (f, _), r in zip(sig, shares(sig), strict=True):
                new[f] += n * r
        s = sum(new.values())
        new = {f: x / s for f, x in new.items()}
        moved = max(abs(new[f] - pi[f]) for f in formats)
        pi = new
        if moved < 1e-9:
            break
    return {sig: (max(range(len(sig)), key=lambda k: (round(r[k], 12), -k)), max(r)) for sig, _ in counts if sig and (r := shares(sig))}


def normalise_instants(df: DataFrame, value: str, zone: str, source: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Add utc_us, fmt, posterior and ambiguous to df; one mixture is fitted per source.

    value, zone and source name columns of df (zone: an IANA name or NULL for UTC).
    Signatures are counted with partial aggregation, so a source with most of the rows is
    no hot group: a source's group holds as many rows as it has signatures, which the
    catalogue of formats bounds.
    """
    weights = dict(weights or {})
    df = df.drop(*({"utc_us", "fmt", "posterior", "ambiguous"} - {value, zone, source}))
    read = df.withColumn("_em_r", readings_column(F.col(value), F.col(zone), weights))
    sig = F.array_join(F.transform("_em_r", lambda r: F.concat(r["fmt"], F.when(_likely(r["utc_us"]), "+").otherwise("-"))), " ")
    read = checkpoint(read.withColumn("_em_sig", sig).withColumn("_em_src", F.coalesce(F.col(source).cast("string"), F.lit("?"))))
    counts = read.where("_em_sig != ''").groupBy("_em_src", "_em_sig").agg(F.count(F.lit(1)).alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        sigs = [tuple((x[:-1], x[-1] == "+") for x in s.split(" ")) for s in group["_em_sig"]]
        best = fit_mixture(list(zip(sigs, group["n"], strict=True)), weights)
        return pd.DataFrame({"_em_src": group["_em_src"], "_em_sig": group["_em_sig"], "_em_k": [best[s][0] for s in sigs], "posterior": [best[s][1] for s in sigs]})

    fitted = checkpoint(counts.groupBy("_em_src").applyInPandas(fit, "_em_src string, _em_sig string, _em_k int, posterior double"))
    chosen = join_checked(read, fitted, ["_em_src", "_em_sig"], value, how="left")
    pick = F.when(F.col("_em_k").isNotNull(), F.get("_em_r", F.col("_em_k")))
    apart = F.exists("_em_r", lambda r: r["utc_us"] != pick["utc_us"])
    return chosen.withColumns({"utc_us": pick["utc_us"], "fmt": pick["fmt"], "ambiguous": F.coalesce(apart & (F.col("posterior") < RESOLVED), F.lit(False))}).drop("_em_r", "_em_sig", "_em_src", "_em_k")


def repository_name(kind: str, column: Column) -> Column:
    """The repository a record belongs to, lower case: from a path or URL, or an e-mail's domain."""
    if kind == "email":
        return F.lower(F.regexp_extract(column, r"@([^@\s]+?)\.[A-Za-z]+\s*$", 1))
    url = F.regexp_extract(column, r"^\s*https?://[^/]+/[^/]+/([^/?#]+)", 1)
    return F.lower(F.when(url != "", url).otherwise(F.regexp_extract(column, r"^\s*(?:\./|/)*([^/]+)", 1)))


def with_zone(df: DataFrame, name: Column, zones: DataFrame) -> DataFrame:
    """Add repo_name and zone (NULL where unknown) from the table of repositories and zones."""
    lookup = zones.select(F.lower(F.trim("name")).alias("repo_name"), "zone").dropDuplicates(["repo_name"])
    df = df.drop("repo_name", "zone")
    return join_checked(df.withColumn("repo_name", F.coalesce(name, F.lit(""))), lookup, ["repo_name"], df.columns, how="left")
