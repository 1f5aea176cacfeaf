"""Filters and top-k lists over symbols, files and imports.

Every order ends in unique columns, so that a limit always cuts at the same row. A name,
kind or scope that is None or empty does not filter. Null names and docstrings match
nothing. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.like import contains, starts
from codelode.operators.architecture import resolve
from codelode.sources.graph import Graph

# Words and names by which handlers and entry points are found.
HANDLER_WORDS = ["handler", "endpoint", "route", "controller"]
HANDLER_KINDS = ["function", "method", "class"]
HTTP_VERBS = ["get", "post", "put", "delete", "patch"]
ENTRY_NAMES = ["main", "Main", "run", "start", "init", "bootstrap", "setup"]
ENTRY_FILES = ["index", "main", "app", "server"]

SHOWN = ["id", "name", "kind", "file", "line_start", "line_end", "col_start", "col_end", "signature", "is_exported", "docstring"]


def index_stats(g: Graph) -> DataFrame:
    """(relation, n): rows of each relation."""
    tables = (("files", g.raw_files), ("symbols", g.raw_symbols), ("references", g.raw_references), ("imports", g.raw_imports))
    counts = [df.select("id").dropna().distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in tables]
    return reduce(DataFrame.unionByName, counts)


def _kind_and_scope(rows: DataFrame, kind: str | None, scope: str | None) -> DataFrame:
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return rows.where(starts(F.col("file"), scope)) if scope else rows


def find_symbols(g: Graph, name: str | None = None, kind: str | None = None, scope: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols whose name contains ``name``: exact matches first, then exported ones, by path."""
    rows = _kind_and_scope(g.placed, kind, scope)
    if name:
        rows = rows.where(contains(F.col("name"), name))
    exact = F.when(F.col("name") == (name or ""), 0).otherwise(1)
    return rows.select(*SHOWN).orderBy(exact, F.desc("is_exported"), "file", "line_start", "id").limit(limit)


def search_docstrings(g: Graph, text: str, kind: str | None = None, scope: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols whose documentation contains the text: exported ones first, by path."""
    rows = _kind_and_scope(g.placed, kind, scope).where(contains(F.col("docstring"), text))
    return rows.select(*SHOWN).orderBy(F.desc("is_exported"), "file", "line_start", "id").limit(limit)


def exports_of(g: Graph, path: str) -> DataFrame:
    """Exported symbols of one file, by line."""
    rows = g.placed.where((F.col("file") == path) & (F.col("is_exported") == 1))
    return rows.select("id", "name", "kind", "line_start", "line_end", "signature", "docstring").orderBy("line_start", "id")


def imports_of(g: Graph, path: str) -> DataFrame:
    """Imports of one file, by line."""
    at = g.files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
    return g.imports.join(at, "file_id").select("id", "source_path", "imported_name", "local_name", "is_default", "is_namespace", "line").orderBy("line", "id")


def imports_by_source(g: Graph, path: str) -> DataFrame:
    """(source_path, names): what one file imports from each source, the names in order of the alphabet."""
    return imports_of(g, path).groupBy("source_path").agg(F.array_join(F.array_sort(F.collect_list("imported_name")), ", ").alias("names"), F.count(F.lit(1)).alias("n"))


def find_by_kind(g: Graph, kind: str, target: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols of a kind whose name or path contains the target."""
    rows = g.placed.where(F.col("kind") == kind)
    if target:
        rows = rows.where(contains(F.col("name"), target) | contains(F.col("file"), target))
    return rows.select("id", "name", "kind", "file", "line_start", "signature", "is_exported").orderBy(F.desc("is_exported"), "file", "line_start", "id").limit(limit)


def find_exports(g: Graph, target: str | None = None, limit: int = 100) -> DataFrame:
    """Exported symbols of the files whose path contains the target, by path and line."""
    rows = g.placed.where(F.col("is_exported") == 1)
    if target:
        rows = rows.where(contains(F.col("file"), target))
    return rows.select("id", "name", "kind", "file", "line_start", "signature").orderBy("file", "line_start", "id").limit(limit)


def _handlers(g: Graph) -> DataFrame:
    rows = g.placed.where(F.col("name").rlike("(?i)" + "|".join(HANDLER_WORDS)) & F.col("kind").isin(*HANDLER_KINDS))
    return rows.select("name", "kind", "file", "line_start", "signature", "id")


def endpoints_by_name(g: Graph, limit: int = 50) -> DataFrame:
    """Functions, methods and classes named like handlers."""
    return _handlers(g).orderBy("file", "line_start", "id").limit(limit)


def endpoints_by_call(g: Graph, limit: int = 50) -> DataFrame:
    """Symbols that call something named like an HTTP verb."""
    calling = g.references.where(F.col("to_symbol_bare_name").isin(*HTTP_VERBS) & (F.col("kind") == "call")).select(F.col("from_symbol_id").alias("id")).distinct()
    return g.placed.join(calling, "id", "left_semi").select("name", "kind", "file", "line_start", "signature", "id").orderBy("file", "line_start", "id").limit(limit)


def endpoints(g: Graph) -> DataFrame:
    """Both lists; of entries with the same file, line and name the handler comes out."""
    both = endpoints_by_name(g).withColumn("rank", F.lit(0)).unionByName(endpoints_by_call(g).withColumn("rank", F.lit(1)))
    best = both.groupBy("file", "line_start", "name").agg(F.min(F.struct("rank", "id", "kind", "signature")).alias("b"))
    return best.select("file", "line_start", "name", "b.kind", "b.signature", "b.rank")


def dependency_of(g: Graph, target: str, limit: int = 100) -> DataFrame:
    """Imports of the files whose path contains the target."""
    files = g.files.where(contains(F.col("path"), target)).select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    return g.imports.join(files, "file_id").select("file", "source_path", "imported_name", "line", "id").orderBy("file", "line", "id").limit(limit)


def module_files(g: Graph, target: str, limit: int = 10) -> DataFrame:
    return g.files.where(contains(F.col("path"), target)).orderBy("path", "id").limit(limit)


def module_summary(g: Graph, target: str, limit: int = 10) -> DataFrame:
    """Per file of the first ``limit`` that match: its exported and other symbols and its imports, as lists in order of line."""
    files = module_files(g, target, limit).select(F.col("id").alias("file_id"), F.col("path").alias("file"))

    def listed(cond: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(cond, F.struct("line_start", "id", F.concat_ws(" ", "kind", "name").alias("label")))))
        return F.array_join(F.transform(rows, lambda x: x["label"]), "; ")

    symbols = g.symbols.join(files, "file_id").groupBy("file_id").agg(listed(F.col("is_exported") == 1).alias("exported"), listed(F.col("is_exported") != 1).alias("other"), F.count(F.lit(1)).alias("n_symbols"))
    sources = g.imports.join(files, "file_id").groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("source_path")), "; ").alias("sources"))
    return files.join(symbols, "file_id", "left").join(sources, "file_id", "left").select("file", F.coalesce("exported", F.lit("")).alias("exported"), F.coalesce("other", F.lit("")).alias("other"), F.coalesce("n_symbols", F.lit(0).cast("long")).alias("n_symbols"), F.coalesce("sources", F.lit("")).alias("sources"))


def entry_functions(g: Graph, limit: int = 20) -> DataFrame:
    rows = g.placed.where(F.col("name").isin(*ENTRY_NAMES) & F.col("kind").isin("function", "method"))
    return rows.select("name", "kind", "file", "line_start", "id").orderBy("file", "line_start", "id").limit(limit)


def entry_files(g: Graph, limit: int = 20) -> DataFrame:
    return g.files.where(F.col("path").rlike(r"(?i)/(" + "|".join(ENTRY_FILES) + r")\.")).select("path", "id").orderBy("path", "id").limit(limit)


def entry_points(g: Graph) -> DataFrame:
    """(name, kind, file, line_start, id): functions named like entry points, then files named so, under kind ``file`` and their path's last part."""
    files = entry_files(g).select(F.substring_index("path", "/", -1).alias("name"), F.lit("file").alias("kind"), F.col("path").alias("file"), F.lit(1).alias("line_start"), "id")
    return entry_functions(g).withColumn("_r", F.lit(0)).unionByName(files.withColumn("_r", F.lit(1))).orderBy("_r", "file", "line_start", "id").drop("_r")


def largest_files(g: Graph, limit: int = 20) -> DataFrame:
    """Files by their number of symbols, those without any included."""
    counts = g.symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    rows = g.files.join(counts, g.files["id"] == counts["file_id"], "left")
    return rows.select("path", "id", F.coalesce("n", F.lit(0).cast("long")).alias("n_symbols")).orderBy(F.desc("n_symbols"), "path", "id").limit(limit)


def projects(g: Graph) -> DataFrame:
    """(project, n_files, n_symbols, n_references, n_imports): the rows below each third path component."""
    parts = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda c: c != "")
    where = g.files.select(F.col("id").alias("file_id"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")).alias("project"))
    owner = g.symbols.select(F.col("id").alias("from_symbol_id"), "file_id")
    per_symbol = g.references.groupBy("from_symbol_id").agg(F.count(F.lit(1)).alias("n"))
    counts = [
        where.groupBy("project").agg(F.count(F.lit(1)).alias("n_files")),
        g.symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).join(where, "file_id").groupBy("project").agg(F.sum("n").alias("n_symbols")),
        per_symbol.join(owner, "from_symbol_id").groupBy("file_id").agg(F.sum("n").alias("n")).join(where, "file_id").groupBy("project").agg(F.sum("n").alias("n_references")),
        g.imports.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).join(where, "file_id").groupBy("project").agg(F.sum("n").alias("n_imports")),
    ]
    out = reduce(lambda a, b: a.join(b, "project", "left"), counts)
    return out.select("project", "n_files", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_symbols", "n_references", "n_imports")])


def definitions(g: Graph) -> DataFrame:
    """(ref_id, definition_id): for each reference the likeliest symbol of its bare name: in the same file, then imported there by name, then exported, then any; ties by id.

    An import counts under its local name and leads to the symbol of the imported name,
    else of the local one, in the file that its source resolves to. An approximation by
    names: no types are inferred, and what ``*`` imports is not told by name. References whose name no symbol has come out with null.
    """
    # Only the columns asked for are taken before repeated rows are dropped, as whole rows fill the disk.
    names = g.raw_symbols.select(F.col("name").alias("to_bare"), F.col("id").alias("def_id"), F.col("file_id").alias("def_file"), F.col("is_exported").alias("def_exported")).distinct()
    per_name = names.groupBy("to_bare").agg(F.min(F.struct((1 - F.col("def_exported")).alias("rank"), F.col("def_id"))).alias("any"))
    local = names.groupBy("to_bare", F.col("def_file").alias("file_id")).agg(F.min("def_id").alias("local_id"))
    paths = g.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    leads = resolve(g).join(paths, "file").join(paths.select(F.col("file_id").alias("def_file"), F.col("file").alias("target")), "target").select("file_id", F.col("source").alias("source_path"), "def_file")
    bound = F.coalesce(F.nullif("local_name", F.lit("")), "imported_name")
    wanted = g.raw_imports.select("file_id", "source_path", "imported_name", "local_name").distinct().join(leads, ["file_id", "source_path"]).select("file_id", "def_file", bound.alias("bound"), F.posexplode(F.array_distinct(F.array("imported_name", bound))).alias("_rank", "to_bare")).distinct()
    imported = wanted.join(names, ["def_file", "to_bare"]).groupBy("file_id", F.col("bound").alias("to_bare")).agg(F.min(F.struct("_rank", (1 - F.col("def_exported")).alias("rank"), "def_id")).alias("imported"))
    refs = g.raw_references.select(F.col("id").alias("ref_id"), "from_symbol_id", F.substring_index("to_symbol_name", ".", -1).alias("to_bare")).distinct()
    placed = refs.join(g.raw_symbols.select(F.col("id").alias("from_symbol_id"), "file_id").distinct(), "from_symbol_id")
    found = placed.join(local, ["to_bare", "file_id"], "left").join(imported, ["to_bare", "file_id"], "left").join(per_name, "to_bare", "left")
    return found.select("ref_id", F.coalesce("local_id", "imported.def_id", "any.def_id").alias("definition_id"))


def implementations(g: Graph) -> DataFrame:
    """(target, n_implementations, n_files): per name the symbols that extend or implement it, by name alone."""
    rows = g.calls.where(F.col("ref_kind").isin("extends", "implements") & F.col("to_bare").isNotNull())
    return rows.select("to_bare", "from_symbol_id", "from_file").distinct().groupBy(F.col("to_bare").alias("target")).agg(F.count(F.lit(1)).alias("n_implementations"), F.countDistinct("from_file").alias("n_files"))
