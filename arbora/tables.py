"""Tables between steps, in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: While a table is written: shuffle files go with the step's end, as what it made is in the table by then; and rows are
#: read, and reach Python, in small batches, so that long texts do not add up.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent and the master is local (tests), a temporary folder is made and recorded as the
    context's checkpoint folder. On a cluster without the setting this raises: a local folder would lose data.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="arbora-shared-"))
    return sc.getCheckpointDir().rstrip("/")


_RUN = uuid.uuid4().hex
_roots: set[str] = set()


def _forget(root: str) -> None:
    """Delete this process's tables when it ends."""
    if SparkContext._gateway is not None:
        jvm, active = SparkContext._gateway.jvm, SparkContext._active_spark_context
        held = active._jsc.hadoopConfiguration() if active is not None else jvm.org.apache.hadoop.conf.Configuration()
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(held).delete(path, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; what a process wrote there goes when it ends."""
    root = f"{shared_dir(spark)}/arbora-{_RUN}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: this cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    held = {key: spark.conf.get(key, None) for key in WHILE_WRITING}
    for key, value in WHILE_WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of an operator's inner steps, deleted together once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        made, path = materialize(df, tag)
        self.paths.append(path)
        return made

    def drop(self) -> None:
        remove(self.spark, *self.paths)
        self.paths = []
