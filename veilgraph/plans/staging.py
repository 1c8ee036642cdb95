"""Tables written to the folder that the cluster shares, to cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark, "_veilgraph_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="spark-veilgraph-", dir="/tmp")
        spark._veilgraph_dir = own
    return own


#: Rows of a partition that an aggregate or a join may hold at once.
ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in partitions of some ROWS each; as it is where the session's own number of them is enough for its rows."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/veilgraph-{what}-{uuid.uuid4().hex[:12]}"


#: Has Spark drop the shuffle files of a query as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The most bytes of a batch that a Python function gets.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def staged(df: DataFrame, what: str = "table", batch: str | None = None) -> DataFrame:
    """df, written once and read back: later jobs neither recompute it nor depend on executors.

    What was shuffled to make it is dropped once it is written. Python functions on the way get batches of `batch` bytes,
    for these are held by executor and worker both. The session's own settings come back.
    """
    path, conf = new_path(df.sparkSession, what), df.sparkSession.conf
    used = {CLEANUP: "true"} | ({BATCH: batch} if batch else {})
    own = {k: conf.get(k, None) for k in used}
    for k, v in used.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in own.items():
            conf.unset(k) if v is None else conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._veilgraph_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    path = getattr(df, "_veilgraph_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
