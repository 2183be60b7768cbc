"""The append-only event log and the tables kept from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(log: DataFrame, types: list[str] | None = None, prefix: str | None = None, source_id: str | None = None) -> DataFrame:
    """Events by type, type prefix and source; all predicates reach the Parquet scan."""
    if types is not None:
        log = log.where(F.col("event_type").isin(types))
    if prefix is not None:
        log = log.where(F.col("event_type").startswith(prefix))
    return log if source_id is None else log.where(F.col("source_id") == source_id)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def payload(data: Column) -> Column:
    """The event's own object as JSON text: a payload that was encoded as a string is decoded,
    an envelope {"v", "payload"} is opened; NULL for invalid JSON."""
    valid = F.when(is_json(data), data)
    opened = F.when(valid.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit("["), valid, F.lit("]")), "$[0]")).otherwise(valid)
    inner = F.get_json_object(opened, "$.payload")
    return F.when(F.get_json_object(opened, "$.v").isNotNull() & inner.isNotNull(), inner).otherwise(opened)


def with_payload(log: DataFrame) -> DataFrame:
    return log.withColumn("payload", payload(F.col("data")))


def json_items(text: Column) -> Column:
    """Items of a JSON array (also one inside a string) as JSON texts; an object is an array of one."""
    return F.from_json(F.when(text.rlike(r"^\s*\{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<string>")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by order, ties by all other columns; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, *(c for c in rest if c not in order))
    best = df.groupBy(*keys).agg(F.max(rank).alias("_best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns))


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """New events with valid JSON, numbered after the log's last; numbers may have gaps."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    numbered = new.where(is_json(F.col("data"))).withColumn("seq", F.monotonically_increasing_id() + F.lit(last + 1))
    return numbered.select(*log.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with the same keys; keep_if_null: columns whose old value survives a NULL."""
    if not keep_if_null:
        return old.join(new, keys, "left_anti").select(*old.columns).unionByName(new)
    before = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep_if_null))
    merged = new.join(before, keys, "left").withColumns({c: F.coalesce(c, f"_old_{c}") for c in keep_if_null}).select(*new.columns)
    return old.join(new, keys, "left_anti").select(*old.columns).unionByName(merged)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti").select(*old.columns))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the sources that new has are replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def prune_missing(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows whose source file is still listed; NULL keys stay."""
    return df.where(F.col(key).isNull()).unionByName(df.join(listing.select(key).distinct(), key, "left_semi").select(*df.columns))


def federate(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of several repositories', tagged with their names; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("repo", F.lit(name)) for name, df in parts.items()])


def write_partitioned(log: DataFrame, path: str, mode: str = "append") -> None:
    """Append events to a table partitioned by type, so that scans by type prune files."""
    log.write.mode(mode).partitionBy("event_type").parquet(path)
