"""File events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.operators.extract import EXTENSIONS, IGNORED
from codelode.session import shared_folder
from codelode.sources.index import Index

EVENT = "event_id long, file_id long, path string, change_kind string, happened_at timestamp_ntz, arrived_at timestamp_ntz"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """File events from the parquet files of a folder, or one file, as they arrive. Events come late and twice; the sink drops repeats by their id, so that no watermark drops the late ones."""
    # As a pattern, the path may be of one file, which the file source otherwise refuses.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder[:-1]}[{folder[-1]}]")


def latest_events(events: DataFrame) -> DataFrame:
    """(path, file_id, change_kind, happened_at): the last event of each path, by time and event id; a known file id is kept if the last event lacks one."""
    last = F.max_by(F.struct("change_kind", "happened_at"), F.struct("happened_at", "event_id"))
    return events.groupBy("path").agg(F.max("file_id").alias("file_id"), last.alias("e")).select("path", "file_id", "e.change_kind", "e.happened_at")


def run_to_end(stream: DataFrame, table: str, key: str | None = None, place: str | None = None) -> DataFrame:
    """Drive a stream through all that is there, with its state in the shared folder, and give what it wrote.

    With ``key`` a row is written only if no batch before it wrote its key, and once per
    batch; how late it comes does not matter. Run again with the same ``place``, the stream
    goes on where it ended. Batches are folders of their number, so one that is run again
    after a failure replaces what it left.
    """
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark)}/{table}-{spark.sql('SELECT uuid()').first()[0]}"

    def written() -> DataFrame:
        return spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch int").option("basePath", f"{place}/out").parquet(f"{place}/out/*")

    def each(rows: DataFrame, number: int) -> None:
        if key:
            rows = rows.dropDuplicates([key])
            if number:
                rows = rows.join(written().where(F.col("batch") < number).select(key), key, "left_anti")
        rows.select(*stream.columns).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return written().drop("batch")


def watch_tree(spark: SparkSession, roots: list[str], apply: Callable[[DataFrame, int], None], state: str, **trigger) -> StreamingQuery:
    """New source files of a tree, batch by batch, to ``apply(batch, number)``, such as that of an ``Index``.

    batch has file, content and modified; of a file seen twice in a batch the later one.
    The file source tells of each path once, so neither of files rewritten in place nor of
    deleted ones: ``watch_index`` compares listings for those. One query per state folder
    runs at a time.
    """
    endings = ",".join(e[1:] for group in EXTENSIONS.values() for e in group)
    schema = "path string, modificationTime timestamp, length long, content binary"

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.regexp_replace("path", r"^file:/*", "/").alias("file"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified")).where(~F.col("file").rlike(IGNORED))
        last = rows.groupBy("file").agg(F.max_by(F.struct("content", "modified"), "modified").alias("r")).select("file", "r.*")
        apply(last, number)

    streams = [
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{endings}}}").load(r) for r in roots
    ]
    both = streams[0]
    for s in streams[1:]:
        both = both.unionByName(s)
    return both.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(**(trigger or {"processingTime": "1 second"})).start()


def watch_index(index: Index, roots: list[str], state: str, seconds: int = 1) -> StreamingQuery:
    """Keep an index in step with its trees: every so many seconds new and rewritten files, told by their hash, are taken in and those that are gone removed."""

    def each(batch: DataFrame, number: int) -> None:
        index.refresh(roots, prune=True)

    ticks = index.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(processingTime=f"{seconds} seconds").start()
