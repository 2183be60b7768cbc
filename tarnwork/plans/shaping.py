"""Plan shaping: cutting lineage, joining under skew, broadcasting only what is small.

All helpers are deterministic: salts come from hashes of the rows, never from rand().
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more rows than this is never broadcast by these helpers.
BROADCAST_ROWS = 20_000
#: application -> folders made for it.
_paths: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in the session's spark.checkpoint.dir.

    Where that is unset a temporary folder serves, but only in local mode: on a cluster
    the setting is required.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tarnwork-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or wide-typed table by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which release() removes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large flat table: write it as Parquet to the shared folder and read it.

    Column statistics and pruning stay available, and it takes a fraction of a checkpoint.
    """
    path = new_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the tables and indexes written for this application, and say how many there were.

    For the end of a job or between jobs: frames made before can't be read any more.
    """
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def salted_join(big: DataFrame, few: DataFrame, keys: list[str], spread_by: str | list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Join big with few (unique on keys) so that one hot key spreads over `salts` tasks.

    Every row of few is repeated once per salt; a row of big goes to the salt its
    spread_by columns hash to, so each row still meets its match exactly once.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*([spread_by] if isinstance(spread_by, str) else spread_by)), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_counted(big: DataFrame, counts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join big with counts (unique on keys, cheap to read), whose column `weight` says how many
    rows of big have the key, or a number that is in proportion to it.

    A small table is broadcast. Otherwise keys with more than a quarter of a task's fair share
    of all rows are: there are at most four per shuffle partition, whatever the data. Only rows
    of the other keys are shuffled, none of which can fill a task.
    """
    n, total, most = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(counts), keys, how)
    share = total / (4 * int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if most <= share:
        return big.join(counts, keys, how)
    heavy = counts.where(F.col(weight) > share)
    near = big.join(F.broadcast(heavy), keys)
    rest = big.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(counts.where(F.col(weight) <= share), keys, how)
    return near.unionByName(rest)


def join_checked(big: DataFrame, few: DataFrame, keys: list[str], spread_by: str | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast few if it has at most `limit` rows (counted now), else join with salts."""
    if few.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(few), keys, how)
    return salted_join(big, few, keys, spread_by, how=how)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows (counted now), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def anti_checked(big: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of big without match in few, which is broadcast if it is small (counted now)."""
    return big.join(small(few.select(*keys).distinct()), keys, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
