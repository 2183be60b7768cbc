from conftest import rows

from tarnwork.operators.orphans import Reference, cascade, direct_orphans, month
from pyspark.sql import functions as F


def ref(spark, tbl, data, target, targets):
    r = spark.createDataFrame(data, "record_id string, k bigint, ref string, period string, target string")
    return Reference(tbl, r, target, spark.createDataFrame(targets, "k bigint, extra string"), ["k"])


def test_direct_orphans(spark):
    data = [("a", 1, "1", "2024-01", "clash"), ("b", 9, "9", "2024-01", ""), ("b", 9, "9", "2024-01", ""), ("c", None, None, "2024-02", ""), ("d", 8, "8", "unknown", None)]
    got = rows(direct_orphans([ref(spark, "t", data, "log", [(1, "x"), (1, "y"), (None, "z")])]))
    assert got == [("t", "b", "9", "2024-01", "log"), ("t", "d", "8", "unknown", "log")]
    assert rows(direct_orphans([ref(spark, "t", [], "log", [(1, "x")])])) == []
    assert len(rows(direct_orphans([ref(spark, "t", data, "log", [])]))) == 3


def test_cascade_reaches_a_fixpoint(spark):
    direct = spark.createDataFrame([("a", "1", "0", "p", "root")], "tbl string, record_id string, ref string, period string, target string")
    edges = spark.createDataFrame([("b", "2", "1", "p", "a", "1"), ("b", "2", "1", "p", "a", "1"), ("c", "3", "2", "p", "b", "2"), ("d", "4", "9", "p", "c", "9"), ("a", "1", "3", "p", "c", "3")], "tbl string, record_id string, ref string, period string, up_tbl string, up_id string")
    got = {(r["tbl"], r["record_id"], r["target"], r["kind"], r["depth"]) for r in cascade(direct, edges).collect()}
    # the cycle a -> b -> c -> a ends
    assert got == {("a", "1", "root", "direct", 0), ("b", "2", "a", "inherited", 1), ("c", "3", "b", "inherited", 2), ("a", "1", "c", "inherited", 3)}


def test_month(spark):
    df = spark.createDataFrame([(1704067199999999,), (None,)], "u bigint")
    assert [r[0] for r in df.select(month(F.col("u"))).collect()] == ["2023-12", "unknown"]
