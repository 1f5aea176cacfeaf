"""Keeping the index in step with the files: skip, replace, remove, reject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content.cast("string"), 256)


def bare_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def split_by_hash(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """scanned (path, hash) plus ``state``: new, changed or unchanged against known (path, hash), one row per path on either side."""
    rows = scanned.join(known.select("path", F.col("hash").alias("_old")), "path", "left")
    return rows.withColumn("state", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("hash"), "unchanged").otherwise("changed")).drop("_old")


def vanished(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """The known paths that the scan no longer saw."""
    return known.join(scanned.select("path").distinct(), "path", "left_anti")


def without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, references and imports without the files (file_id) in gone, and all that hangs on them."""
    gone = gone.select("file_id").distinct()
    lost = tables["symbols"].join(gone, "file_id", "left_semi").select(F.col("id").alias("from_symbol_id")).distinct()
    return {
        "files": tables["files"].join(gone.select(F.col("file_id").alias("id")), "id", "left_anti"),
        "symbols": tables["symbols"].join(gone, "file_id", "left_anti"),
        "references": tables["references"].join(lost, "from_symbol_id", "left_anti"),
        "imports": tables["imports"].join(gone, "file_id", "left_anti"),
    }


def replace_files(tables: dict[str, DataFrame], parsed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the rows of the parsed files in the place of what those files had. Parsed tables have the same columns."""
    kept = without_files(tables, parsed["files"].select(F.col("id").alias("file_id")))
    return {k: kept[k].unionByName(parsed[k].select(*kept[k].columns)) for k in kept}


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """symbols plus ``kept``: of rows with equal name, kind, file and line only the one with the least id is kept."""
    place = F.row_number().over(Window.partitionBy("name", "kind", "file_id", "line_start").orderBy("id"))
    return symbols.withColumn("kept", (place == 1).cast("int"))


def ordinals(symbols: DataFrame) -> DataFrame:
    """(id, file_id, ordinal): a symbol's place in its file, from 0, by line, column and id."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("line_start", "col_start", "id"))
    return symbols.select("id", "file_id", (place - 1).cast("long").alias("ordinal"))


def remap_parents(symbols: DataFrame) -> DataFrame:
    """(id, file_id, ordinal, parent_ordinal): parents as places in the same file; those elsewhere or missing become null."""
    placed = ordinals(symbols)
    parents = placed.select(F.col("id").alias("parent_symbol_id"), "file_id", F.col("ordinal").alias("parent_ordinal"))
    links = placed.join(symbols.select("id", "parent_symbol_id"), "id")
    return links.join(parents, ["parent_symbol_id", "file_id"], "left").select("id", "file_id", "ordinal", "parent_ordinal")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in sorted(tables.items())])
