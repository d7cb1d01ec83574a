"""Session settings the jobs rely on. All are runtime SQL settings; none replaces the cluster's own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # timestamps are stored as UTC text
    "spark.sql.session.timeZone": "UTC",
    # a repeated key in a JSON object keeps its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # hot keys: let AQE split skewed join partitions even when that costs another exchange
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # whole texts go to Python in batches of a bounded size
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

#: What a join may broadcast without being told to, in bytes as stored or shuffled. In the driver's memory these are many times as
#: much: stored tables are compressed, exploded rows aren't counted, and a query has several joins at once.
BROADCAST_BYTES = 256 << 10

#: removes a run's shuffle files when it ends, instead of when the driver's memory is next collected
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it. A lower limit of the session's own on broadcasts stays."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    # the adaptive limit is unset by default and then is the static one; a negative one broadcasts nothing
    for name, given in ((static, spark.conf.get(static)), (adaptive, spark.conf.get(adaptive, None))):
        if given and not given.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) > BROADCAST_BYTES:
            spark.conf.set(name, str(BROADCAST_BYTES))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; as an explicit number AQE doesn't coalesce it by bytes.

    For rows that are cheap to move and costly to work on, such as documents before they are parsed.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    Below `spark.checkpoint.dir` where the session names one, else below the warehouse. A warehouse
    on a local disk serves only a local master; on a cluster that is refused, since each executor
    would write to a disk of its own.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not base:
        warehouse = context._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        resolved = warehouse.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(warehouse)
        if resolved.toUri().getScheme() == "file" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{resolved}/_intermediate"
    return f"{base.rstrip('/')}/devident-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    given = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, given)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read from there.

    Cuts the lineage: what follows neither repeats the work above nor depends on an executor that
    did it, and each later pass reads only the columns it needs. The shuffle files behind it go once
    it is written; the plan that wrote it is never run again.
    """
    return _write(df, shared_folder(df.sparkSession))


@contextmanager
def held() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A `materialize` whose tables are deleted at the end of the block.

    What leaves the block must not read them any more, so it is written by then.
    """
    written = []

    def hold(df: DataFrame) -> DataFrame:
        path = shared_folder(df.sparkSession)
        written.append((df.sparkSession, path))
        return _write(df, path)

    try:
        yield hold
    finally:
        for spark, path in written:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
