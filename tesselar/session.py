"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    It is enough where executors see the driver's folders (local mode, a shared home); elsewhere ship the package with
    --py-files or install it on the executors.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HOME, *paths])
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tesselar")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in spark.checkpoint.dir.

    Only a local session that has none gets a temporary one.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where is None and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tesselar-checkpoint-")
        sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame, *, loop: bool = False) -> DataFrame:
    """df, computed once into the shared checkpoint folder, so that a lost executor costs no lineage.

    A checkpoint keeps its plan's estimate of size, and joins multiply estimates: in a loop their digits would grow
    without end, until planning took longer than the work. With loop the estimate is forgotten, with the partitioning.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    done = df.checkpoint(eager=True)
    if not loop:
        return done
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it's there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
