from datetime import UTC, datetime

import pytest

from tarnwork.operators import instants as I

SCHEMA = "id string, value string, zone string, source string, utc_us bigint, fmt string"


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2024-03-31 02:30:00", "Europe/Berlin", us(2024, 3, 31, 1, 30)),  # skipped, moves on
        ("2024-10-27 02:30:00", "Europe/Berlin", us(2024, 10, 27, 0, 30)),  # twice, the earlier
        ("2024-11-03 01:30:00 America/New_York", None, us(2024, 11, 3, 5, 30)),
        ("2024-01-18T05:12:36+05:30[Asia/Kolkata]", "UTC", us(2024, 1, 17, 23, 42, 36)),
        ("2024-03-14T12:53:03−04:00", "UTC", us(2024, 3, 14, 16, 53, 3)),
        ("2024-01-09 22:02:30,278 +01:00", "UTC", us(2024, 1, 9, 21, 2, 30) + 278_000),
        ("2024-01-07T11:19:29.768351665Z", "UTC", us(2024, 1, 7, 11, 19, 29) + 768_351),
        ("Fri, 04 Oct 2024 19:37:46 +0100", None, us(2024, 10, 4, 18, 37, 46)),
        ("Wed Jun 5 03:59:00 2024 -0400", None, us(2024, 6, 5, 7, 59)),
        ("1 Jan 2026 05:43:44 GMT", None, us(2026, 1, 1, 5, 43, 44)),
        ("\xa02024-02-08 14:21:04 UTC+11:00\n", None, us(2024, 2, 8, 3, 21, 4)),
        ("20240108-021730", "Asia/Tokyo", us(2024, 1, 7, 17, 17, 30)),
        ("20240109t135037z".upper(), "Asia/Tokyo", us(2024, 1, 9, 13, 50, 37)),
        ("2026-04-25 22:57:45+10", None, us(2026, 4, 25, 12, 57, 45)),
        ("2024-08-04 11:50 CEST", None, us(2024, 8, 4, 9, 50)),
    ],
)
def test_single_reading(text, zone, want):
    assert [u for _, u in I.readings(text, zone)] == [want]


@pytest.mark.parametrize("text", [None, "", " ", "TBD", "n/a", "-", "2025-02-30 10:00:00", "2025-13-40T25:61:00Z", "0000-00-00 00:00:00", "last tuesday", "2024-01-01 10:00 Nowhere/City", "12/31/2024 13:00:00 PM"])
def test_no_reading(text):
    assert I.readings(text, "Europe/Berlin") == []


def normal(spark, data, weights=None):
    df = spark.createDataFrame([(*r, None, "clash") for r in data], SCHEMA)
    return {r["id"]: r for r in I.normalise_instants(df, "value", "zone", "source", weights).collect()}


def test_conventions_and_epochs(spark):
    got = normal(spark, [("a", "01/02/2024 03:04:05 PM", "UTC", "s"), ("b", "01.02.2024 03:04:05", "UTC", "s"), ("c", "13/02/2024 03:04:05 PM", "UTC", "s"), ("d", "1705683003", None, "s"), ("e", "1705683003419", None, "s"), ("f", "1705683003419973", None, "s"), ("g", "1705683003419973123", None, "s")], I.MONTH_FIRST_SLASH_DAY_FIRST_DOT)
    assert got["a"]["utc_us"] == us(2024, 1, 2, 15, 4, 5) and got["b"]["utc_us"] == us(2024, 2, 1, 3, 4, 5) and got["c"]["utc_us"] is None
    assert [got[k]["utc_us"] for k in "defg"] == [1705683003_000000, 1705683003_419000, 1705683003_419973, 1705683003_419973]


def test_mixture_of_the_source_decides_without_conventions(spark):
    days = [(f"e{d}", f"{d:02}/03/2024 10:00:00", "UTC", "european") for d in range(13, 29)] + [(f"u{d}", f"03/{d:02}/2024 10:00:00", "UTC", "american") for d in range(13, 29)]
    got = normal(spark, [*days, ("x", "05/06/2024 10:00:00", "UTC", "european"), ("y", "05/06/2024 10:00:00", "UTC", "american"), ("z", "05/06/2024 10:00:00", "UTC", "alone"), ("t", "06/06/2024 10:00:00", "UTC", "alone")])
    assert got["x"]["utc_us"] == us(2024, 6, 5, 10) and not got["x"]["ambiguous"] and got["x"]["posterior"] > 0.9
    assert got["y"]["utc_us"] == us(2024, 5, 6, 10) and not got["y"]["ambiguous"]
    assert got["z"]["ambiguous"] and got["z"]["posterior"] < 0.9
    assert not got["t"]["ambiguous"]  # both readings are the same instant


def test_nulls_empty_table_and_extra_columns(spark):
    got = normal(spark, [("a", None, None, None), ("b", "2024-01-01T00:00:00Z", None, None), ("c", "2024-01-01 00:00:00", "No/Zone", None)])
    assert got["a"]["utc_us"] is None and got["b"]["utc_us"] == got["c"]["utc_us"] == us(2024, 1, 1)
    assert normal(spark, []) == {}


def test_zone_lookup(spark):
    df = spark.createDataFrame([("x@Lantern.EXAMPLE", "u"), (None, "u"), ("nobody", "u")], "email string, zone string")
    zones = spark.createDataFrame([("o/lantern", "lantern", "Europe/Berlin")], "repo string, name string, zone string")
    from pyspark.sql import functions as F

    out = I.with_zone(df, I.repository_name("email", F.col("email")), zones).collect()
    assert {r["email"]: r["zone"] for r in out} == {"x@Lantern.EXAMPLE": "Europe/Berlin", None: None, "nobody": None}
    paths = spark.createDataFrame([("lantern/.git",), ("https://forge.example/o/lantern/issues/9",), ("./lantern",), (None,)], "p string")
    assert [r[0] for r in paths.select(I.repository_name("path", F.col("p"))).collect()] == ["lantern", "lantern", "lantern", None]
