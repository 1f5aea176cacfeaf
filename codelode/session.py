"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the session's ``spark.checkpoint.dir``; where that is unset, a local run makes its own, while a cluster must name one, as a folder of one machine would be lost with it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the copy. What nothing refers to any more may be cleaned there, if the session is set so."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut, and the number of rows written, which costs no pass of its own."""
    seen = Observation()
    written = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return written, seen.get["rows"]


def spread_out(df: DataFrame, key: str) -> DataFrame:
    """df over at least three partitions per core, for work that is heavy per row; left alone if it has as many.

    Large inputs come in enough partitions of their own, and are then not shuffled.
    """
    wanted = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)
