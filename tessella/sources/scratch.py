"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder below the warehouse of a session on one machine (tests, a laptop)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``base_folder``, removed when the driver ends."""
    folder = f"{base_folder(spark)}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: computed once, read by column, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer partitions than there are cores, dealt to all of them; larger scans stay as they are.

    Only where it is cheap: such an input is a few splits long.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: rows in an Arrow batch of texts; what the JVM and a Python worker hold of texts at once is in proportion to it
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` rows in the session from then on (unless it asks for fewer)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
