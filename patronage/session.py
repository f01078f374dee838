"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# A join on a hot customer is split by AQE even where the split costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


BYTES_PER_PARTITION = 64 * 1024 ** 2  # of Parquet, which grows a few times in a shuffle
PER_CORE = 3  # least number of partitions: among few of them none stands out as skewed


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Runtime settings; with the input size, shuffles also start with enough partitions for it.

    AQE merges small partitions but never adds any, so the first number has to fit the largest input.
    """
    conf = dict(RUNTIME_CONF)
    if input_bytes is not None:
        wanted = max(-(-input_bytes // BYTES_PER_PARTITION), PER_CORE * spark.sparkContext.defaultParallelism)
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(wanted)
    for key, value in conf.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or where that is unset a folder in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
