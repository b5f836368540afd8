"""Intermediate tables in the cluster's shared folder, and joins with small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a
    temporary folder in local mode and the warehouse elsewhere."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        app, local = spark.sparkContext.applicationId, spark.sparkContext.master.split("[")[0] == "local"
        got = _OWN_DIRS.get(app) or (tempfile.mkdtemp(prefix="paperloom-") if local else spark.conf.get("spark.sql.warehouse.dir"))
        _OWN_DIRS[app] = got
    return got.rstrip("/")


#: Spark drops the shuffle files of a query at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that survive the
    loss of executors, and the shuffle files that led to them go. The files go when the application ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # for this call only
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing will read again, which is the case once all that was made of it is stored too."""
    spark = table.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_name(table: DataFrame, base: str) -> str:
    """A column name that ``table`` doesn't have, in any case."""
    taken = {c.lower() for c in table.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Rows of a small table that are broadcast; a larger one is joined by key, with the keys of the large side dealt out.
BROADCAST_ROWS, SALTS = 50_000, 16


def with_small(rows: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``small`` (stored, one row per non-null ``key``), as a left join. Beyond ``BROADCAST_ROWS`` rows of ``small``
    a key's rows are dealt out over ``SALTS`` copies of its row by their long column ``spread``, so that a common key is no single task's."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, "left")
    salt = fresh_name(rows, "salt")
    dealt = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(dealt, [key, salt], "left").drop(salt)
