"""Items that appear together: pair counts with large-basket blocking, and association.

Baskets of at most `block` items give their pairs in one row. A larger basket is split into
chunks of about `block` items by the items' hashes; every pair of chunks becomes a unit of
its own, so its product is made by many tasks, none holding more than two chunks. Pair
counts add up over both kinds with map-side combination. Items travel as 64-bit hashes that
are checked to be free of collisions (another salt is taken if not), baskets as 128-bit
digests; names return only to the pairs that are reported.

Results for edge cases: NULL baskets or items are no members; an item repeated in a basket
counts once; baskets of one item count as baskets but give no pair; empty inputs give
empty results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.shaping import join_counted, written

BLOCK = 32


def encode_items(df: DataFrame, basket: str, item: str, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Distinct (basket, id), the dictionary (id, name) and the hash of a name column; more: (name),
    further names that are hashed and must not collide with the items."""
    names = df.select(F.col(item).alias("name"))
    names = (names if more is None else names.unionAll(more.select("name"))).where(F.col("name").isNotNull()).distinct()
    for salt in range(8):
        hashed = lambda c, salt=salt: F.xxhash64(c, F.lit(salt))
        items = written(names.select(hashed(F.col("name")).alias("id"), "name"))
        if items.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise ValueError("no salt keeps the items' hashes apart")
    both = F.col(basket).isNotNull() & F.col(item).isNotNull()
    members = df.where(both).select(F.unhex(F.md5(F.col(basket).cast("string"))).alias("basket"), hashed(F.col(item)).alias("id")).distinct()
    return members, items, hashed


def basket_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))


def with_sizes(members: DataFrame) -> DataFrame:
    """members with the size of their basket; a basket with a large share of all rows is not shuffled."""
    members = written(members)
    return join_counted(members, written(basket_sizes(members)), ["basket"], "size")


def basket_count(sized: DataFrame) -> int:
    """Baskets of sized members: each member counts for 1 / size, so nothing has to be made distinct."""
    return round(sized.agg(F.coalesce(F.sum(1 / F.col("size")), F.lit(0.0))).first()[0])


def _all_pairs(ids: Column) -> Column:
    """Unordered pairs within one array of distinct ids, smaller id first."""
    ordered = F.array_sort(ids)
    return F.flatten(F.transform(ordered, lambda x, i: F.transform(F.slice(ordered, i + 2, F.greatest(F.size(ordered) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def _products(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def basket_pairs(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): one row per pair of ids per basket of sized(basket, id, size)."""
    chunks = F.ceil(F.col("size") / block).cast("int")
    parts = sized.withColumn("chunks", chunks).withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")).otherwise(0))
    lists = parts.groupBy("basket", "chunks", "chunk").agg(F.collect_list("id").alias("ids"))
    ordinary = lists.select(F.explode(_all_pairs(F.col("ids"))).alias("p")).select("p.a", "p.b")
    # a chunk goes to its unit with every other chunk of the basket; a unit gets two lists
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    sent = lists.where("chunks > 1").select("basket", "chunk", "ids", others.alias("other")).where("chunk != other")
    unit = sent.groupBy("basket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).agg(
        F.first(F.when(F.col("chunk") < F.col("other"), F.col("ids")), ignorenulls=True).alias("left"), F.first(F.when(F.col("chunk") > F.col("other"), F.col("ids")), ignorenulls=True).alias("right")
    )
    across = unit.where("left is not null and right is not null").select(F.explode(_products(F.col("left"), F.col("right"))).alias("p")).select("p.a", "p.b")
    return ordinary.unionByName(across)


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def with_lift(pairs: DataFrame, support: DataFrame, n: int) -> DataFrame:
    """Add na, nb and lift = c*n/(na*nb) to pairs(a, b, c); support: (id, support), cheap to read."""
    a, b = support.select(F.col("id").alias("a"), F.col("support").alias("na")), support.select(F.col("id").alias("b"), F.col("support").alias("nb"))
    # an item is in no more pairs than its baskets give, so its support tells whether it is hot
    met = join_counted(join_counted(pairs, a, ["a"], "na"), b, ["b"], "nb")
    return met.withColumn("lift", F.col("c") * F.lit(n) / (F.col("na") * F.col("nb")))


def named(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Replace ids by names, file_a < file_b by code point."""
    pairs = written(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    names = written(items.join(wanted, "id"))
    side = lambda key, name: names.select(F.col("id").alias(key), F.col("name").alias(name), "_n")
    met = join_counted(join_counted(pairs, side("a", "_x"), ["a"], "_n").drop("_n"), side("b", "_y"), ["b"], "_n").drop("_n")
    return met.withColumns({"file_a": F.least("_x", "_y"), "file_b": F.greatest("_x", "_y")}).drop("_x", "_y", "a", "b")
