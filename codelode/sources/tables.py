"""The four index relations and the other tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: rows that were delivered twice are equal, so any of them will do."""
    return df.dropDuplicates([key])


def first_seen(files: DataFrame) -> DataFrame:
    """(file_id, path, first_at) per file: its earliest ``indexed_at``."""
    return (
        files.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("file_id"))
        .agg(F.min("path").alias("path"), F.min("indexed_at").alias("first_at"))
    )


def latest(files: DataFrame) -> DataFrame:
    """One row per file with the hash and time of its latest indexing."""
    last = F.max_by(F.struct("path", "hash", "indexed_at"), F.struct("indexed_at", "hash"))
    return files.groupBy("id").agg(last.alias("f")).select("id", "f.path", "f.hash", "f.indexed_at")
