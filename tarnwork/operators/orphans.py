"""References to records that do not exist: direct orphans, and those inherited from them.

Relations form a graph of foreign keys. A record is a direct orphan if one of its non-null
references has no target. Children of orphaned records are orphans by inheritance; a
fixpoint over semi-joins down the graph finds them. Nothing is collected; the loop ends
when a round adds no record, which for an acyclic graph is at most its depth.

Results for edge cases: a NULL reference is no reference; NULL keys in targets match
nothing; targets may come later than their children; repeated rows count once; empty
children give an empty report, empty targets make every reference an orphan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.shaping import checkpoint

SCHEMA = "tbl string, record_id string, ref string, period string, target string"


@dataclass
class Reference:
    """References of one table. rows: (record_id, ref, period, key...); keys name columns of
    rows and targets that must be equal; target names the relation referred to."""

    tbl: str
    rows: DataFrame
    target: str
    targets: DataFrame
    keys: list[str]


def direct_orphans(refs: list[Reference]) -> DataFrame:
    """(tbl, record_id, ref, period, target): every non-null reference without target."""
    found = None
    for r in refs:
        lost = r.rows.where(F.col("ref").isNotNull()).join(r.targets.select(*r.keys).dropDuplicates(), r.keys, "left_anti")
        lost = lost.select(F.lit(r.tbl).alias("tbl"), "record_id", "ref", "period", F.lit(r.target).alias("target")).distinct()
        found = lost if found is None else found.unionByName(lost)
    return found


def cascade(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """Add orphans by inheritance to direct ones.

    edges: (tbl, record_id, ref, period, up_tbl, up_id): references that do have a target.
    Returns direct's columns with kind (direct or inherited) and depth; a record that is a
    direct orphan through one reference may inherit through another.
    """
    known = checkpoint(direct.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)}))
    front, depth = known.select(F.col("tbl").alias("up_tbl"), F.col("record_id").alias("up_id")).distinct(), 0
    links = checkpoint(edges.distinct())
    while True:
        depth += 1
        new = links.join(front, ["up_tbl", "up_id"], "left_semi").select("tbl", "record_id", "ref", "period", F.col("up_tbl").alias("target"), F.lit("inherited").alias("kind"), F.lit(depth).alias("depth")).distinct()
        new = checkpoint(new.join(known.select("tbl", "record_id", "ref", "target"), ["tbl", "record_id", "ref", "target"], "left_anti").select(*known.columns))
        if new.isEmpty():
            return known
        known = checkpoint(known.unionByName(new))
        front = new.select(F.col("tbl").alias("up_tbl"), F.col("record_id").alias("up_id")).distinct()


def month(utc_us: Column) -> Column:
    """YYYY-MM in UTC, `unknown` for NULL."""
    return F.coalesce(F.date_format(F.timestamp_micros(utc_us), "yyyy-MM"), F.lit("unknown"))
