"""Session helpers: reading a table of a data directory, and durable cuts of a plan in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()
CHECKPOINT = "spark.checkpoint.dir"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only where none is set (a single machine, as in tests) a temporary one is used."""
    folder = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        folder = current or f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        if not current:
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(frame: DataFrame) -> DataFrame:
    """The frame's rows as a table in the shared folder: the plan is cut, and a lost executor costs no recomputation.

    All of an application's tables lie in one folder of its own, which is deleted when the application ends.
    """
    path = new_path(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A path for a new table in the application's own folder."""
    folder = f"{shared_folder(spark)}/factloom-{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OWN.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def spread(frame: DataFrame) -> DataFrame:
    """The frame in as many partitions as the cluster has cores where it has fewer than half of that, for work that is dear per row; others are not shuffled."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if 2 * frame._jdf.rdd().getNumPartitions() < cores else frame


def byte_size(frame: DataFrame) -> int:
    """Catalyst's estimate of a frame's size, for choices that need a checked bound."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
