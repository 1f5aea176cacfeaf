"""Which file imports which, and the directories between which imports run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.paths import directory, directory_at_depth, normalise
from codelode.operators.orphans import SUFFIXES
from codelode.sources.graph import Graph

# What may follow a package import at the end of a path.
PACKAGE_SUFFIXES = ["", ".ts", ".js"]


def _files(g: Graph, scope: str | None) -> DataFrame:
    from codelode.functions.like import starts

    return g.files.where(starts(F.col("path"), scope)) if scope else g.files


def import_sources(g: Graph, scope: str | None = None) -> DataFrame:
    """(file, source): each file in scope with what it imports, files without imports with null."""
    files = _files(g, scope).select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    return files.join(g.imports.select("file_id", F.col("source_path").alias("source")), "file_id", "left").select("file", "source").distinct()


def resolve(g: Graph, scope: str | None = None) -> DataFrame:
    """(file, source, target): imports that lead to a file in scope.

    A source that starts with a dot is taken from the importing file's directory and tried
    with each ending in turn. Any other is met on the end of a path after a slash, as it
    is or with .ts or .js, and the first such path in order of the alphabet is taken.
    """
    pairs = import_sources(g, scope).where(F.col("source").isNotNull())
    paths = _files(g, scope).select("path").distinct()
    dotted = pairs.where(F.col("source").startswith(".")).withColumn("_base", normalise(F.concat(directory(F.col("file")), F.lit("/"), F.col("source"))))
    ends = F.array_compact(F.array(*[F.when(F.col("path").endswith(s), F.struct(F.expr(f"left(path, length(path) - {len(s)})").alias("_base"), F.lit(i).alias("_rank"))) for i, s in enumerate(SUFFIXES)]))
    by_base = paths.select("path", F.explode(ends).alias("e")).groupBy("e._base").agg(F.min_by("path", "e._rank").alias("target"))
    relative = dotted.join(by_base, "_base").select("file", "source", "target")
    named = pairs.where(~F.col("source").startswith("."))
    whole = paths.select("path", F.explode(F.array_compact(F.array(*[F.when(F.col("path").endswith(s), F.expr(f"left(path, length(path) - {len(s)})")) for s in PACKAGE_SUFFIXES]))).alias("_p"))
    # The end after each slash of the path; a source may itself hold slashes.
    parts = F.split("_p", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    by_tail = whole.where(F.col("_p").contains("/")).select("path", F.explode(tails).alias("source")).groupBy("source").agg(F.min("path").alias("target"))
    return relative.unionByName(named.join(by_tail, "source").select("file", "source", "target"))


def module_edges(g: Graph, scope: str | None = None) -> DataFrame:
    """(source_file, target_file): distinct edges between files."""
    return resolve(g, scope).select(F.col("file").alias("source_file"), F.col("target").alias("target_file")).distinct()


def modules_without_edges(g: Graph, scope: str | None = None) -> DataFrame:
    """(path): files in scope that import no file in scope."""
    return _files(g, scope).select("path").distinct().join(module_edges(g, scope).select(F.col("source_file").alias("path")), "path", "left_anti")


def directory_edges(g: Graph, scope: str | None = None, depth: int = 2) -> DataFrame:
    """(source_dir, target_dir, n_edges): edges between directories cut at ``depth`` (1 to 5), those within one left out."""
    depth = max(1, min(5, depth))
    edges = module_edges(g, scope).select(directory_at_depth(F.col("source_file"), depth).alias("source_dir"), directory_at_depth(F.col("target_file"), depth).alias("target_dir"))
    return edges.where(F.col("source_dir") != F.col("target_dir")).groupBy("source_dir", "target_dir").agg(F.count(F.lit(1)).alias("n_edges"))


def directory_groups(g: Graph, scope: str | None = None, depth: int = 2) -> DataFrame:
    """(dir, n_files) of the files in scope."""
    return _files(g, scope).groupBy(directory_at_depth(F.col("path"), max(1, min(5, depth))).alias("dir")).agg(F.count(F.lit(1)).alias("n_files"))
