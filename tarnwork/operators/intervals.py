"""As-of joins of points with the latest interval that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_match(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str, point_id: str, span_id: str, width_s: int) -> DataFrame:
    """Each point with the interval of its keys that holds it and begins last.

    Intervals are laid over time buckets of width_s (about their usual length), so the range
    condition becomes an equi-join on keys and bucket, and a long history of one key spreads
    over its buckets; the last match is kept by an aggregate that combines before the shuffle.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width_s * 1_000_000))
    laid = spans.withColumn("_b", F.explode(F.sequence(bucket(begin), bucket(end))))
    met = points.withColumn("_b", bucket(at)).join(laid, [*keys, "_b"]).where((F.col(begin) <= F.col(at)) & (F.col(at) <= F.col(end)))
    rest = [c for c in points.columns if c not in (point_id, *keys)]
    last = met.groupBy(point_id, *keys).agg(*(F.first(c).alias(c) for c in rest), F.max(F.struct(begin, span_id)).alias("_m"))
    return last.select(point_id, *keys, *rest, F.col(f"_m.{begin}").alias(begin), F.col(f"_m.{span_id}").alias(span_id))
