"""What a change of lines touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.like import fold
from codelode.operators.closure import BROADCAST_ROWS, heavy_owners, meet_names, owners_of, reference_closure, standing, with_folded_keys
from codelode.session import cut_counted
from codelode.sources.graph import Graph


def symbols_in_ranges(g: Graph, ranges: DataFrame) -> DataFrame:
    """Symbols that overlap the ranges (file, first, last) of lines; the join is on the file, the overlap a residual."""
    hit = g.placed_with("name", "kind", "line_start", "line_end", "is_exported").join(ranges, "file").where((F.col("line_start") <= F.col("last")) & (F.col("line_end") >= F.col("first")))
    return hit.select("id", "name", "kind", "file", "line_start", "line_end", "is_exported").distinct()


def dependents(g: Graph, changed: DataFrame, depth: int, drop_self: bool) -> DataFrame:
    """(id, depth, from_symbol, from_file, paths): for each changed symbol (id, name, file) what refers to it, all symbols in one closure.

    drop_self leaves out references from the symbol's own name in its own file.
    """
    roots = changed.select(F.col("name").alias("root")).distinct()
    closure = reference_closure(g, roots, depth).groupBy("root", "depth", "from_symbol", "from_file").agg(F.sum("paths").alias("paths"))
    own = changed.select("id", F.col("name").alias("root"), "file")
    rows = closure.join(own, "root")
    if drop_self:
        rows = rows.where(~((F.col("from_file") == F.col("file")) & (F.col("from_symbol") == F.col("root"))))
    return rows.select("id", "depth", "from_symbol", "from_file", "paths")


def impact_counts(changed: DataFrame, reached: DataFrame) -> DataFrame:
    """Per changed symbol: direct and total dependents, and the files they are in."""
    per = reached.groupBy("id").agg(
        F.sum(F.when(F.col("depth") == 1, F.col("paths")).otherwise(0)).alias("direct"), F.sum("paths").alias("total"), F.countDistinct("from_file").alias("n_files")
    )
    zero = F.lit(0).cast("long")
    return changed.join(per, "id", "left").select(*changed.columns, *[F.coalesce(c, zero).alias(c) for c in ("direct", "total", "n_files")])


def with_direct_counts(g: Graph, changed: DataFrame, many: bool) -> DataFrame:
    """changed (name, file, ...) plus total, n_files: the references to each symbol's name, and the files they are in; those from the same name in the same file left out.

    The counts are made per name, and those that are left out per name and file, so that no
    symbol is met with the references to its name one by one: both may be many. If ``many``
    symbols may have changed, all names are counted, on a key that may be skewed in a join
    whose parts adaptive execution splits; else ``changed`` runs twice, and its names go to
    the scan of the references if they are few.
    """
    n = BROADCAST_ROWS + 1
    names = (g.raw_symbols if many else changed).select(F.col("name").alias("root")).dropna().distinct()
    if not many:
        names, n = cut_counted(names)
    # Files of one path are one place. References from files without a path are in no place.
    first = F.min("file_id").over(Window.partitionBy("file"))
    places = g.paths.withColumn("place", F.when(F.col("file").isNotNull(), first))
    owners, heavy = owners_of(g, places.select("file_id", "place")), heavy_owners(g)
    if n <= BROADCAST_ROWS:
        met = standing(meet_names(with_folded_keys(g.outgoing_raw), F.broadcast(names)), owners, heavy)
    else:
        dotted = not g.raw_symbols.where(F.col("name").contains(".")).isEmpty()
        keyed = with_folded_keys(standing(g.outgoing_raw, owners, heavy), dotted)
        # Names that can't be the one met give way to a short one that can't either.
        other = F.when(fold(F.col("from_symbol")) != F.col("_k"), F.when(F.col("_k") == "", "x").otherwise("")).otherwise(F.col("from_symbol"))
        met = meet_names(keyed.select("_k", "_x", "_but", "place", other.alias("from_symbol")), names)
    # As in SQL, a symbol without a name can't be told from the one met.
    own = F.coalesce(F.col("from_symbol") == F.col("root"), F.lit(True))
    # Read twice below, and shuffled once as long as no filter on it differs: hence the join by <=>.
    met = met.where(F.col("root").isNotNull()).groupBy("root", "place").agg(F.count(F.lit(1)).alias("_n"), F.count_if(own).alias("_own"))
    total = F.when(F.col("place").isNull(), F.col("_n") - F.col("_own")).otherwise(F.col("_n"))
    per = met.groupBy(F.col("root").alias("name")).agg(F.sum(total).alias("_total"), F.count("place").alias("_files"))
    at = places.where(F.col("file_id") == F.col("place")).select(F.col("place").alias("_place"), "file")
    left_out = met.where(F.col("_own") > 0).join(at, F.col("place").eqNullSafe(F.col("_place")))
    left_out = left_out.select(F.col("root").alias("name"), "file", "_own", (F.col("_own") == F.col("_n")).cast("long").alias("_alone"))
    # What is left out of a name and file stands beside its symbols, laid out by name as the counts are.
    beside = Window.partitionBy("name", "file")
    both = changed.withColumn("_row", F.lit(True)).unionByName(left_out, allowMissingColumns=True).repartition("name")
    rows = both.withColumns({c: F.max(c).over(beside) for c in ("_own", "_alone")}).where("_row").join(per, "name", "left")
    zero = F.lit(0).cast("long")
    return rows.select(*changed.columns, *[(F.coalesce(a, zero) - F.coalesce(b, zero)).alias(c) for a, b, c in (("_total", "_own", "total"), ("_files", "_alone", "n_files"))])


def change_impact(g: Graph, path: str, first: int, last: int, depth: int = 2) -> DataFrame:
    """The symbols of one file that lines first..last touch, with the number of their dependents."""
    ranges = g.files.sparkSession.createDataFrame([(path, first, last)], "file string, first int, last int")
    changed = symbols_in_ranges(g, ranges)
    return impact_counts(changed, dependents(g, changed, depth, drop_self=False))
