"""The code graph: four relations, each row once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.sources.tables import first_seen, load

SYMBOL = ["id", "name", "kind", "file_id", "line_start", "line_end", "col_start", "col_end", "parent_symbol_id", "signature", "is_exported", "docstring"]
REFERENCE = ["id", "from_symbol_id", "to_symbol_name", "to_symbol_bare_name", "to_file_id", "kind", "line", "col"]
IMPORT = ["id", "file_id", "source_path", "imported_name", "local_name", "is_default", "is_namespace", "line"]


@dataclass(frozen=True)
class Graph:
    """The relations of one index.

    Rows delivered twice have equal fields, so they are dropped by grouping on the columns
    asked for, the id among them: only those are read and shuffled, and filters still move
    below the grouping to the scan. ``symbols``, ``references`` and ``imports`` have all
    columns; questions that need few ask for those.
    """

    raw_files: DataFrame
    raw_symbols: DataFrame
    raw_references: DataFrame
    raw_imports: DataFrame

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Graph:
        return Graph(*(load(spark, folder, t) for t in ("files", "symbols", "references_", "imports")))

    @cached_property
    def files(self) -> DataFrame:
        return first_seen(self.raw_files).select(F.col("file_id").alias("id"), "path")

    def symbols_with(self, *columns: str) -> DataFrame:
        return self.raw_symbols.select("id", *columns).distinct()

    def symbols_by_file(self, *columns: str) -> DataFrame:
        """The same with file_id, laid out by it: what is then joined on it needs no shuffle of its own."""
        return self.raw_symbols.select("id", "file_id", *columns).repartition("file_id").distinct()

    def references_with(self, *columns: str) -> DataFrame:
        return self.raw_references.select("id", *columns).distinct()

    def imports_with(self, *columns: str) -> DataFrame:
        return self.raw_imports.select("id", *columns).distinct()

    @cached_property
    def symbols(self) -> DataFrame:
        return self.symbols_with(*SYMBOL[1:])

    @cached_property
    def references(self) -> DataFrame:
        return self.references_with(*REFERENCE[1:])

    @cached_property
    def imports(self) -> DataFrame:
        return self.imports_with(*IMPORT[1:])

    def placed_with(self, *columns: str) -> DataFrame:
        """Symbols with these columns and the path of their file."""
        return self.symbols_with("file_id", *columns).join(self.paths, "file_id")

    @cached_property
    def paths(self) -> DataFrame:
        return self.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))

    @cached_property
    def placed(self) -> DataFrame:
        """Symbols with the path of their file."""
        return self.symbols.join(self.paths, "file_id")

    @cached_property
    def outgoing_raw(self) -> DataFrame:
        """References under the names used for answers, as delivered, some of them twice."""
        return self.raw_references.where(F.col("id").isNotNull()).select(
            F.col("id").alias("ref_id"), "from_symbol_id", F.col("to_symbol_name").alias("to_symbol"), F.col("to_symbol_bare_name").alias("to_bare"),
            F.col("kind").alias("ref_kind"), F.col("line").alias("ref_line"), F.col("col").alias("ref_col"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        """References with the name, kind, line and file of the symbol they stand in."""
        owners = self.placed_with("name", "kind", "line_start").select(
            F.col("id").alias("from_symbol_id"), F.col("name").alias("from_symbol"), F.col("kind").alias("from_kind"), F.col("file").alias("from_file"), F.col("line_start").alias("from_line")
        )
        return self.outgoing_raw.distinct().join(owners, "from_symbol_id")

    def register(self) -> None:
        """Temporary views of the relations for use from SQL."""
        for name, df in (("g_files", self.files), ("g_symbols", self.symbols), ("g_references", self.references), ("g_imports", self.imports)):
            df.createOrReplaceTempView(name)
