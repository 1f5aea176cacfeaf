"""A stored index of source trees: what is appended per refresh, and what of it is live.

Every refresh appends the rows of the files that it parsed, under a version of its own,
and then one row per file to ``files``; that last write is what makes the version count.
A file's live rows are those of its latest version. So a refresh writes only what changed,
a removal is one row, and a refresh that fails half-way leaves rows that no one reads.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.operators.extract import scan_sources
from codelode.operators.maintenance import content_hash, split_by_hash, vanished
from codelode.session import cut
from codelode.sources.graph import IMPORT, REFERENCE, SYMBOL, Graph
from codelode.sources.projects import scan_tree

#: Ids of a file's rows run from its own id times this; a file with more rows of one kind fails.
FILE_SPAN = 1 << 20
FILE = "id long, path string, hash string, indexed_at timestamp_ntz"
SCHEMAS = {
    "files": f"{FILE}, gone boolean, version long",
    "symbols": "id long, name string, kind string, file_id long, line_start int, line_end int, col_start int, col_end int, parent_symbol_id long, signature string, is_exported int, docstring string, version long",
    "references": "id long, from_symbol_id long, to_symbol_name string, to_symbol_bare_name string, to_file_id long, kind string, line int, col int, file_id long, version long",
    "imports": "id long, file_id long, source_path string, imported_name string, local_name string, is_default int, is_namespace int, line int, version long",
}


def dense_ids(rows: DataFrame, order: str, first: int) -> DataFrame:
    """rows plus ``id``, counted from ``first`` in order of a column: ranges are numbered each by its own task, behind the sizes of those before it."""
    ranged = cut(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = dict(ranged.groupBy("_part").count().collect())
    starts, at = [], first
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_n", place).join(F.broadcast(offsets), "_part").withColumn("id", F.col("_start") + F.col("_n") - 1).drop("_part", "_n", "_start")


def _row_id(file_id: str, ordinal: Column) -> Column:
    return F.col(file_id) * FILE_SPAN + F.when(ordinal < FILE_SPAN, ordinal).otherwise(F.raise_error(F.lit("a file has more rows than ids")))


def index_rows(files: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, references, imports and rejects, with their ids, of (id, path, hash, content).

    Of symbols with equal name, kind, file and line the first is kept; the others come out
    as rejects, and what they hold or refer to goes to the one that was kept.
    """
    files = files.withColumn("indexed_at", F.current_timestamp().cast("timestamp_ntz"))
    found = scan_sources(files.select(F.col("path").alias("file"), "content"))
    at = files.select(F.col("path").alias("file"), F.col("id").alias("file_id"))
    symbols = found["symbols"].join(at, "file")
    same = Window.partitionBy("file_id", "name", "kind", "line_start").orderBy("ordinal")
    symbols = cut(symbols.withColumn("_kept", F.first("ordinal").over(same)))
    kept = symbols.select("file_id", F.col("ordinal").alias("_of"), "_kept")
    parents = kept.select("file_id", F.col("_of").alias("parent_ordinal"), F.col("_kept").alias("_parent"))
    numbered = symbols.drop("_kept").join(kept.withColumnRenamed("_of", "ordinal"), ["file_id", "ordinal"]).join(parents, ["file_id", "parent_ordinal"], "left")
    numbered = numbered.select(_row_id("file_id", F.col("ordinal")).alias("id"), "*", (F.col("file_id") * FILE_SPAN + F.col("_parent")).alias("parent_symbol_id"))
    owners = kept.select("file_id", F.col("_of").alias("from_ordinal"), (F.col("file_id") * FILE_SPAN + F.col("_kept")).alias("from_symbol_id"))
    refs = found["references"].join(at, "file").join(owners, ["file_id", "from_ordinal"])
    by_place = Window.partitionBy("file_id").orderBy("line", "col", "kind", "to_symbol_name", "from_symbol_id")
    refs = refs.withColumn("_n", F.row_number().over(by_place) - 1).withColumn("to_file_id", F.lit(None).cast("long"))
    imported = Window.partitionBy("file_id").orderBy("line", "source_path", "imported_name", "local_name")
    imports = found["imports"].join(at, "file").withColumn("_n", F.row_number().over(imported) - 1)
    return {
        "files": files.select("id", "path", "hash", "indexed_at"),
        "symbols": numbered.where("ordinal = _kept").select(*SYMBOL),
        "references": refs.select(_row_id("file_id", F.col("_n")).alias("id"), *REFERENCE[1:], "file_id"),
        "imports": imports.select(_row_id("file_id", F.col("_n")).alias("id"), *IMPORT[1:]),
        "rejects": numbered.where("ordinal <> _kept").select(*SYMBOL),
    }


class Index:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _stored(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    def files(self) -> DataFrame:
        """The live files with the version that holds their rows."""
        stored = self._stored("files")
        last = F.max_by(F.struct("path", "hash", "indexed_at", "gone", "version"), F.struct("version", "indexed_at"))
        return stored.groupBy("id").agg(last.alias("f")).select("id", "f.*").where(~F.col("gone")).drop("gone")

    def tables(self) -> dict[str, DataFrame]:
        """files, symbols, references and imports that are live."""
        live = self.files()
        held = live.select(F.col("id").alias("file_id"), "version")
        rows = {t: self._stored(t).join(held, ["file_id", "version"], "left_semi") for t in ("symbols", "references", "imports")}
        return {"files": live.drop("version"), "symbols": rows["symbols"].select(*SYMBOL), "references": rows["references"].select(*REFERENCE), "imports": rows["imports"].select(*IMPORT)}

    def graph(self) -> Graph:
        t = self.tables()
        return Graph(t["files"], t["symbols"], t["references"], t["imports"])

    def _version(self) -> int:
        last = self._stored("files").agg(F.max("version")).first()[0] or 0
        return max(last + 1, time.time_ns() // 1_000_000)

    def _append(self, table: str, rows: DataFrame, version: int) -> None:
        rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy("version").parquet(f"{self.folder}/{table}")

    def put(self, parsed: dict[str, DataFrame]) -> None:
        """Store the rows of some files in the place of what those files had. References have their owner's ``file_id``."""
        version = self._version()
        for table in ("symbols", "references", "imports"):
            self._append(table, parsed[table], version)
        self._append("files", parsed["files"].withColumn("gone", F.lit(False)), version)

    def remove(self, gone: DataFrame) -> None:
        """Remove files (file_id) and all that hangs on them."""
        live = self.files().join(gone.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
        self._append("files", live.drop("version").withColumn("gone", F.lit(True)), self._version())

    def update(self, scanned: DataFrame) -> dict[str, int]:
        """Parse and store those of (file, content, hash) that are new or changed; a changed file keeps its id. Returns how many were indexed and skipped."""
        known = cut(self.files().select("path", "hash", "id"))
        sources = cut(scanned.select(F.col("file").alias("path"), "hash", "content"))
        state = split_by_hash(sources, known)
        counts = dict(state.groupBy("state").count().collect())
        changed = state.where("state = 'changed'").join(known.select("path", "id"), "path").select("id", "path", "hash", "content")
        first = (self._stored("files").agg(F.max("id")).first()[0] or 0) + 1
        fresh = dense_ids(state.where("state = 'new'").select("path", "hash", "content"), "path", first).select("id", "path", "hash", "content")
        todo = counts.get("new", 0) + counts.get("changed", 0)
        if todo:
            self.put(index_rows(cut(changed.unionByName(fresh))))
        return {"indexed": todo, "skipped": counts.get("unchanged", 0)}

    def refresh(self, roots: list[str], prune: bool = False) -> dict[str, int]:
        """Scan trees and store what is new or changed, judged by hash before anything is parsed; with ``prune`` remove the files that are gone from them."""
        scanned = scan_tree(self.spark, roots)
        done = self.update(scanned)
        if prune:
            under = None
            for r in roots:
                here = F.col("path").startswith(r.rstrip("/") + "/")
                under = here if under is None else under | here
            lost = cut(vanished(scanned.select(F.col("file").alias("path")), self.files().where(under).select("path", "id")))
            done["removed"] = lost.count()
            if done["removed"]:
                self.remove(lost.select(F.col("id").alias("file_id")))
        return done

    def apply(self, batch: DataFrame, number: int = 0) -> None:
        """Take a batch of ``watch_tree`` in; a batch that is delivered again changes nothing, as its hashes are known by then."""
        self.update(batch.select("file", "content").withColumn("hash", content_hash(F.col("content"))))
