"""Transitive references, callees and dependencies, by counted frontiers.

A level of a closure is kept as (name, number of paths that lead to it) instead of one row
per path: a step joins the frontier with the references on their match keys and sums the
counts per name. So rows per level are bounded by names, while the counts stay those of
the bag of paths, duplicates and cycles included. Names are matched literally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.like import fold
from codelode.operators.skew import heavy_keys, spread_join
from codelode.session import cut, cut_counted
from codelode.sources.graph import Graph

CALLING = ["call", "instantiation"]
DETAIL = ["ref_id", "to_symbol", "ref_kind", "ref_line", "ref_col", "from_symbol", "from_kind", "from_file", "from_line"]
#: What tells symbols apart where their number counts; the same columns wherever a plan reads them, so that they are shuffled once.
OWNER = ["name", "kind", "line_start", "line_end", "is_exported"]
#: A level, or what it hits, of up to so many rows is broadcast; their count is known by then.
BROADCAST_ROWS = 100_000
#: Letters in the runs on which sources are met with paths.
GRAM = 3


def with_match_keys(refs: DataFrame) -> DataFrame:
    """refs (to_symbol, to_bare, ...), once per ``key`` that a frontier name must equal to match: ``e:`` and the full or bare name, ``p:`` and in lower case what comes before each dot.

    Written with a running number instead of lists, so that it stays in generated code.
    """
    full, bare, i = F.col("to_symbol"), F.col("to_bare"), F.col("_i")
    dots = F.coalesce(F.length(full) - F.length(F.translate(full, ".", "")), F.lit(0))
    prefix = F.concat(F.lit("p:"), fold(F.expr("substring_index(to_symbol, '.', _i)")))
    other = F.when(full.isNull() | (full != bare), F.concat(F.lit("e:"), bare))
    key = F.when(i == -1, F.concat(F.lit("e:"), full)).when(i == 0, other).otherwise(prefix)
    return refs.withColumn("_i", F.explode(F.sequence(F.lit(-1), dots))).withColumn("key", key).drop("_i").where(F.col("key").isNotNull())


def _as_keys(frontier: DataFrame) -> DataFrame:
    both = F.array(F.concat(F.lit("e:"), F.col("name")), F.concat(F.lit("p:"), fold(F.col("name"))))
    return frontier.select("root", "name", "paths", F.explode(both).alias("key"))


def _expand(closure: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """One row per path, as many as can be among the first ``limit``."""
    if limit is None:
        return closure
    most = closure.orderBy(*order).limit(limit)
    return most.withColumn("path_no", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("paths"), F.lit(limit))))).orderBy(*order, "path_no").limit(limit).drop("paths", "path_no")


def _meet(rows: DataFrame, wanted: DataFrame, n: int, on: list[str], spread: list[str]) -> DataFrame:
    """Inner join of rows, in which a key may hold a large share, with a written table of n rows. Few wanted rows go to the scan of ``rows``, so that this is not shuffled; many are met by a salted join."""
    return rows.join(F.broadcast(wanted), on) if n <= BROADCAST_ROWS else spread_join(rows, wanted, on, "inner", spread)


def _owned(g: Graph, hits: DataFrame, n: int, columns: dict[str, str]) -> DataFrame:
    """hits, a written table of n rows, with these columns of the symbols they stand in; of few hits the symbols are met where they are read."""
    owners = g.raw_symbols.select(F.col("id").alias("from_symbol_id"), *[F.col(c).alias(a) for c, a in columns.items()])
    return owners.join(F.broadcast(hits), "from_symbol_id").distinct() if n <= BROADCAST_ROWS else spread_join(hits, owners.distinct(), ["from_symbol_id"], "inner", ["ref_id"])


def reference_closure(g: Graph, roots: DataFrame, depth: int) -> DataFrame:
    """References that lead to each root name in up to ``depth`` steps (1 to 10), with their number of paths.

    roots has one column ``root``. A reference leads to a name if its full or bare name is
    that, or its full name goes on after it with a dot, in any case. The next step looks
    for references to the symbol in which the reference stands. Each step reads the
    references once and keeps those that meet the level's names before anything is joined
    to them or repeated rows are dropped; what is written is the level's answer.
    """
    depth = max(1, min(10, depth))
    keyed = with_match_keys(g.outgoing_raw)
    frontier = roots.select("root", F.col("root").alias("name"), F.lit(1).cast("long").alias("paths")).distinct()
    levels = []
    for level in range(1, depth + 1):
        ahead, n = cut_counted(_as_keys(frontier))
        if not n and levels:
            break
        # No reference matches one name twice, as bare name and as prefix.
        meets = F.col("key").startswith("e:") | F.col("to_bare").isNull() | (F.col("name") != F.col("to_bare"))
        met = _meet(keyed, ahead, n, ["key"], ["ref_id"]).where(meets).drop("key", "to_bare").distinct()
        hits, n = cut_counted(met.groupBy(*[c for c in met.columns if c not in ("paths", "name")]).agg(F.sum("paths").alias("paths")))
        owned = _owned(g, hits, n, {"name": "from_symbol", "kind": "from_kind", "line_start": "from_line", "file_id": "file_id"})
        found = cut(owned.join(g.paths.withColumnRenamed("file", "from_file"), "file_id").select("root", *DETAIL, "paths"))
        levels.append(found.withColumn("depth", F.lit(level)))
        frontier = found.groupBy("root", F.col("from_symbol").alias("name")).agg(F.sum("paths").alias("paths"))
    return reduce(DataFrame.unionByName, levels)


def owners_of(g: Graph, files: DataFrame) -> DataFrame:
    """(from_symbol_id, from_symbol, files' columns but file_id) of every symbol whose file is in files (file_id, ...), with one shuffle by file for both the repeated rows and the join."""
    owners = g.symbols_by_file(*OWNER).join(files, "file_id").drop("file_id", *OWNER[1:])
    return owners.withColumnsRenamed({"id": "from_symbol_id", "name": "from_symbol"})


def heavy_owners(g: Graph) -> DataFrame | None:
    return heavy_keys(g.outgoing_raw.select("from_symbol_id").dropna(), ["from_symbol_id"])


def standing(refs: DataFrame, owners: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """refs as delivered, each once, with the columns of the symbol it stands in; one shuffle of the references does both, unless some symbol holds a large share of them."""
    on = ["from_symbol_id"]
    if heavy is None:
        # Packed for the shuffle: the bare name only where it isn't the last part of the full one (empty: null), the rest as one text.
        bare, last = F.col("to_bare"), F.substring_index("to_symbol", ".", -1)
        rest = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ref_line", "ref_col")], "ref_kind")
        packed = refs.withColumns({"_b": F.when(bare == last, None).otherwise(F.coalesce(F.concat(F.lit("="), bare), F.lit(""))), "_r": rest}).drop("to_bare", "ref_kind", "ref_line", "ref_col")
        unpacked = packed.repartition(*on).distinct().withColumn("to_bare", F.when(F.col("_b").isNull(), last).when(F.col("_b") != "", F.expr("substring(_b, 2)")))
        return unpacked.drop("_b", "_r").join(owners, on)
    return spread_join(refs.distinct(), owners, on, "inner", ["ref_id"], known=(heavy,))


def with_folded_keys(refs: DataFrame, dotted: bool = True) -> DataFrame:
    """with_match_keys, without names that hold a dot unless ``dotted``, each key as ``_k`` in lower case, ``_x`` as it is (null for what comes before a dot) and ``_but``, the bare name where that alone could meet the same name again."""
    text, exact = F.expr("substring(key, 3)"), F.col("key").startswith("e:")
    keyed = with_match_keys(refs).withColumn("_k", fold(text)).withColumn("_x", F.when(exact, text))
    keyed = keyed if dotted else keyed.where(F.col("_x").isNull() | ~F.col("_x").contains("."))
    return keyed.withColumn("_but", F.when(~exact & (fold(F.col("to_bare")) == F.col("_k")), F.col("to_bare"))).drop("key")


def meet_names(keyed: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of with_folded_keys with each of the names (one column ``root``) that they lead to."""
    asked = names.select("root", fold(F.col("root")).alias("_k"))
    return keyed.join(asked, "_k").where((F.col("_x") == F.col("root")) | (F.col("_x").isNull() & (F.col("_but").isNull() | (F.col("_but") != F.col("root"))))).drop("_k", "_x", "_but")


def path_counts(g: Graph, roots: DataFrame, depth: int) -> DataFrame:
    """(root, depth, n_paths): how many paths of up to ``depth`` steps (1 to 10) lead to each root name, for many roots at once.

    The same counts as those of reference_closure, taken from the far end: the paths of d
    steps to a name are, summed over the references that lead to it, the paths of d - 1
    steps to the symbol they stand in. So a step keeps a number per name and depth, and
    never a row per root and reference. All steps shuffle the references alike, which is
    done once.
    """
    depth = max(1, min(10, depth))
    owners = owners_of(g, g.raw_files.select(F.col("id").alias("file_id")).dropna().distinct())
    heavy = heavy_owners(g)
    roots = roots.select("root").distinct()
    counts, known = None, []
    for level in range(1, depth + 1):
        ahead = owners if counts is None else owners.join(counts.withColumnRenamed("root", "from_symbol"), "from_symbol", "left")
        rows = standing(g.outgoing_raw, ahead.select("from_symbol_id", *known), heavy)
        steps = [F.lit(1).cast("long").alias("_1"), *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(f"_{int(c[1:]) + 1}") for c in known]]
        known = [f"_{d}" for d in range(1, level + 1)]
        sums = [F.sum(c).alias(c) for c in known]
        keyed = with_folded_keys(rows.select("to_symbol", "to_bare", *steps)).groupBy("_k", "_x", "_but").agg(*sums)
        names = roots if level == depth else owners.select(F.col("from_symbol").alias("root")).distinct()
        counts = meet_names(keyed, names).groupBy("root").agg(*sums)
    levels = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"_{d}").alias("n_paths")) for d in range(1, depth + 1)])
    return counts.select("root", F.inline(levels)).where(F.col("n_paths") > 0)


def references_to(g: Graph, name: str, depth: int = 1, limit: int | None = 200) -> DataFrame:
    """The references to one name, nearest first, one row per path."""
    roots = g.files.sparkSession.createDataFrame([(name,)], "root string")
    rows = reference_closure(g, roots, depth).drop("root")
    return _expand(rows, ["depth", "from_file", "ref_line", "ref_col", "ref_id"], limit)


def callee_closure(g: Graph, name: str, depth: int = 2, limit: int | None = 100) -> DataFrame:
    """What a function calls or instantiates, and what the symbols of those names do, in up to ``depth`` steps (1 to 5)."""
    depth = max(1, min(5, depth))
    calls = g.raw_references.where(F.col("kind").isin(*CALLING) & F.col("id").isNotNull())
    calls = calls.select(F.col("id").alias("ref_id"), "from_symbol_id", F.col("to_symbol_name").alias("callee"), F.col("to_symbol_bare_name").alias("callee_bare"), F.col("kind").alias("ref_kind"), F.col("line").alias("ref_line"))
    owners = g.raw_symbols.select(F.col("id").alias("from_symbol_id"), F.col("name").alias("caller"))
    frontier = g.files.sparkSession.createDataFrame([(name, 1)], "caller string, paths long")
    levels = []
    for level in range(1, depth + 1):
        # The symbols of the level's names first, then what stands in them.
        frontier, n = cut_counted(frontier)
        callers, n = cut_counted(_meet(owners, frontier, n, ["caller"], ["from_symbol_id"]).distinct())
        hit = cut(_meet(calls, callers, n, ["from_symbol_id"], ["ref_id"]).distinct())
        levels.append(hit.select("ref_id", "caller", "callee", "callee_bare", "ref_kind", "ref_line", "paths", F.lit(level).alias("depth")))
        names = F.array_distinct(F.array_compact(F.array("callee", "callee_bare")))
        frontier = hit.withColumn("_next", F.explode(names)).groupBy(F.col("_next").alias("caller")).agg(F.sum("paths").alias("paths"))
    return _expand(reduce(DataFrame.unionByName, levels), ["depth", "ref_line", "callee", "ref_id"], limit)


def first_per_depth(closure: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each depth and key the first row in the given order."""
    others = [c for c in closure.columns if c not in ("depth", *keys)]
    best = closure.groupBy("depth", *keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_b"))
    return best.select("depth", *keys, "_b.*")


def dependency_closure(g: Graph, path: str, depth: int = 2, limit: int | None = 100) -> DataFrame:
    """Imports of a file, and of the files whose path contains an imported source, in up to ``depth`` steps.

    The step is a containment test, ASCII letter case aside, which no key can narrow. It is
    made between the level's distinct sources and the distinct paths.
    """
    depth = max(1, min(5, depth))
    imports = g.raw_imports.where(F.col("id").isNotNull()).select(F.col("id").alias("import_id"), "file_id", F.col("source_path").alias("source"))
    frontier = g.paths.where(F.col("file") == path).withColumn("paths", F.lit(1).cast("long"))
    levels = []
    for level in range(1, depth + 1):
        frontier, n = cut_counted(frontier)
        hit = cut(_meet(imports, frontier, n, ["file_id"], ["import_id"]).distinct())
        levels.append(hit.select("import_id", "file", "source", "paths", F.lit(level).alias("depth")))
        if level < depth:
            sources = cut(hit.groupBy("source").agg(F.sum("paths").alias("paths")))
            frontier = _containing(g, sources).groupBy("file_id", "file").agg(F.sum("paths").alias("paths"))
    return _expand(reduce(DataFrame.unionByName, levels), ["depth", "file", "source", "import_id"], limit)


def _containing(g: Graph, sources: DataFrame) -> DataFrame:
    """(file_id, file, source, paths): files whose path contains the source; sources are a written table.

    A source is met on that run of three of its letters which fewest paths hold, a shorter
    one on all of its letters. Few sources go to the scan of the paths; many are met by a
    salted join, as a run such as that of a common folder may be in every path.
    """
    wanted = sources.where(F.length("source") > 0).withColumn("_s", fold(F.col("source")))
    lengths = [r[0] for r in wanted.select(F.least(F.length("_s"), F.lit(GRAM))).distinct().collect()]
    if not lengths:
        return g.paths.select("file_id", "file", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("paths")).limit(0)

    def run(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    def runs(text: Column, sizes: list[int]) -> Column:
        return F.array_distinct(F.concat(*[run(text, n) for n in sizes]))

    paths = g.paths.withColumn("_p", fold(F.col("file"))).withColumn("_g", F.explode(runs(F.col("_p"), lengths)))
    # How many paths hold each run: a source is asked for under the run that fewest hold.
    common = cut(paths.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    asked = wanted.withColumn("_g", F.explode(runs(F.col("_s"), [GRAM]))).join(common, "_g", "left")
    rarest, n = cut_counted(asked.groupBy("source", "paths", "_s").agg(F.min(F.struct(F.coalesce("_n", F.lit(0).cast("long")).alias("_n"), "_g")).alias("_m")).where(F.col("_m._n") > 0).select("source", "paths", "_s", F.col("_m._g").alias("_g")))
    met = _meet(paths, rarest, n, ["_g"], ["file_id"])
    return met.where(F.col("_p").contains(F.col("_s"))).select("file_id", "file", "source", "paths")
