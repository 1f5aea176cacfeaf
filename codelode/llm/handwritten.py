"""Files that nobody wrote by hand: generated, minified, built, vendored, data saved as code."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.skew import spread_join
from codelode.session import cut
from codelode.sources.tables import first_seen

# Directory names that tell what lies below them.
VENDORED_DIRS = """vendor vendors vendored node_modules jspm_packages bower_components web_modules third_party third-party thirdparty 3rdparty 3rd_party 3rd-party external externals extern deps bundled
    packagecache site-packages dist-packages .venv venv virtualenv .tox .nox .eggs godeps _godeps carthage pods .cargo .yarn .pnpm .pnpm-store elm-stuff .gradle .mvn""".split()
BUILD_DIRS = """dist build _build out .output target classes obj coverage lcov-report htmlcov .nyc_output .next .nuxt .svelte-kit .parcel-cache .turbo .cache __pycache__ storybook-static deriveddata""".split()
GENERATED_DIRS = """gen generated _generated __generated__ .generated autogen generated-sources generated-src generated_src generated-test-sources""".split()
# File names that generators, bundlers and minifiers give.
GENERATED_NAMES = [
    r"_pb2(_grpc)?\.pyi?$", r"[._]pb\.\w+$", r"_(grpc_)?pb\.(js|ts|d\.ts)$", r"\.pb\.(validate|gw)\.\w+$", r"\.pb(objc|rpc)\.[hm]$", r"Grpc\.java$", r"OuterClass\.java$", r"^AutoValue_\w+\.java$",
    r"_Impl\.java$", r"\.g(en)?\.\w+$", r"[._-]generated\.\w+$", r"[._-]autogen(erated)?\.\w+$", r"^zz_generated\w*\.\w+", r"_easyjson\.go$", r"_ffjson\.go$", r"wire_gen\.go$", r"_string(er)?_gen\.go$", r"^bindata\.go$",
    r"\.tab\.(c|h|cc|cpp|hpp)$", r"\.yy\.(c|h|cc|cpp)$", r"^lex\.\w+\.(c|cc|cpp)$", r"^parsetab\w*\.py$", r"^lextab\w*\.py$", r"^(ui|moc|qrc)_\w+\.(h|hpp|cpp|cc|py)$", r"_rc\.py$", r"_bindgen\.rs$", r"^bindings_\w+\.rs$",
    r"_wrap\.(c|cc|cpp|cxx)$", r"\.designer\.(cs|vb)$", r"\.(freezed|mocks)\.\w+$", r"^R\.java$",
]
BUNDLED_NAMES = [r"[.-]min\.(js|mjs|cjs|css)$", r"\.(bundle|packed|bundled|chunk)\.(js|mjs|cjs|css)$", r"[.-][0-9a-f]{8,64}\.(js|mjs|cjs|css)$", r"^chunk-[0-9a-zA-Z]{6,}\.(js|mjs)$"]
BUILD_DIR_NAMES = r"^cmake-build-[\w-]+$"
# What generators say of a whole file, as against notes on one function.
GENERATOR_NOTE = (
    r"(?iu)\bauto-?generated\b(?!\s+(method|function|constructor|getter|setter|catch|stub))|@generated\b|\bcode generated\b|\bfile (was|is|has been) (automatically |auto-?)?generated\b|\bgenerated (automatically|by [\w .-]+\W+(do not|don't)|from [\w .-]+\W+(do not|don't))"
    r"|\bgenerated by\b[^.]*\bdo not edit\b|\bdo not edit (this file|manually|by hand)\b|\b(erzeugt|generiert) (durch|von|mit)\b|\bnicht (von hand|manuell) ändern\b|\bgénéré (par|automatiquement)\b|\bgenerado (por|automáticamente)\b"
)

#: A line this long does not come from a keyboard; nor does a single value of that many lines.
LONG_LINE, LONG_VALUE = 1000, 1000
#: Fingerprints: symbols per k-gram, k-grams per window, and the block of text that is read as one stream.
K, WINDOW, BLOCK_LINES, BLOCK_COLUMNS = 4, 4, 256, 4096
#: A fingerprint recurs if this many projects hold it; a file is a copy if this share of its fingerprints do.
MIN_PROJECTS, COPIED_SHARE = 3, 0.6
#: Files of fewer fingerprints say too little of where they come from.
LEAST_PRINTS = 3


def _components(path: Column) -> Column:
    return F.split(F.translate(path, "\\", "/"), "/")


def project(path: Column) -> Column:
    """The project of an absolute path: its third component, whichever slashes it has."""
    return F.try_element_at(F.filter(_components(path), lambda c: c != ""), F.lit(3))


def path_reason(path: Column) -> Column:
    """What the path tells: vendored, build, generated, bundled, or null if it is silent.

    Only directories below the project count, so that a checkout under, say, /build/ is not judged by that.
    """
    parts = F.filter(_components(path), lambda c: c != "")
    name = F.element_at(parts, -1)
    dirs = F.transform(F.slice(parts, 4, F.greatest(F.size(parts) - 4, F.lit(0))), F.lower)

    def under(names: list[str]) -> Column:
        return F.arrays_overlap(dirs, F.array(*map(F.lit, names)))

    def named(patterns: list[str]) -> Column:
        return name.rlike("|".join(f"(?:{p})" for p in patterns))

    return (
        F.when(F.size(parts) < 1, None)
        .when(under(VENDORED_DIRS), "vendored")
        .when(under(BUILD_DIRS) | F.exists(dirs, lambda d: d.rlike(BUILD_DIR_NAMES)), "build")
        .when(under(GENERATED_DIRS) | named(GENERATED_NAMES), "generated")
        .when(named(BUNDLED_NAMES), "bundled")
    )


def shape_reason(symbols: DataFrame) -> DataFrame:
    """(file_id, shape): what a file's symbols tell: generated, bundled, data.

    generated: the documentation of the file's first symbol is a generator's note on the
    file. bundled: lines too long for hands, and at least half of the names of three letters
    at most. data: nothing but values, one of them longer than LONG_VALUE lines, and less
    than one symbol in as many lines. All of it is combined before the shuffle.
    """
    place = F.struct("line_start", "col_start", "id")
    span = F.col("line_end") - F.col("line_start")
    value = F.col("kind").isin("variable", "property")
    per = symbols.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(
        F.min_by("docstring", place).alias("first_doc"),
        F.max("col_end").alias("width"),
        F.max("line_end").alias("height"),
        F.avg((F.length("name") <= 3).cast("int")).alias("short"),
        F.max(F.when(value, span)).alias("longest"),
        F.coalesce(F.max((~value).cast("int")), F.lit(0)).alias("code"),
        F.count(F.lit(1)).alias("n"),
    )
    shape = (
        F.when(F.col("first_doc").rlike(GENERATOR_NOTE), "generated")
        .when((F.col("width") >= LONG_LINE) & (F.col("short") >= 0.5), "bundled")
        .when((F.col("code") == 0) & (F.col("longest") >= LONG_VALUE) & (F.col("n") * LONG_VALUE <= F.col("height")), "data")
    )
    return per.select("file_id", shape.alias("shape")).where(F.col("shape").isNotNull())


def _mixed(tokens: np.ndarray) -> np.ndarray:
    """Hash of each run of K tokens."""
    out = np.zeros(max(len(tokens) - K + 1, 0), np.uint64)
    for i in range(K):
        out = (out ^ tokens[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(tokens: np.ndarray, own: int) -> np.ndarray:
    """The distinct least hashes of the windows of k-grams that begin at the first ``own`` tokens; windows cut short by the end count as they are."""
    grams = _mixed(tokens)
    padded = np.append(grams, np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64))
    starts = min(own, len(grams))
    return np.unique(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[:starts].min(axis=1)) if starts else grams[:0]


def fingerprints(symbols: DataFrame) -> DataFrame:
    """(file_id, print): winnowed fingerprints of each file's stream of symbols.

    The token of a symbol is its kind and its name without case; parameters and what else a
    signature holds, which differ from version to version, are left out. Streams are read in blocks of lines and
    columns, so that no task holds the symbols of a whole file however large it is. Each
    block is given the K + WINDOW - 2 symbols that follow it, found over the heads of the
    blocks behind it, so no window is lost at an edge and the prints do not depend on where
    the edges fall. Files of fewer than K symbols have no print. Symbols delivered twice
    count once, those without id or file not at all.
    """
    rows = symbols.select("id", "file_id", "kind", "name", "line_start", "col_start").where(F.col("file_id").isNotNull() & F.col("id").isNotNull())
    token = F.xxhash64(F.concat_ws("\u0001", "kind", F.lower("name")))
    block = [F.expr(f"coalesce(line_start, 0) div {BLOCK_LINES}").alias("_b"), F.expr(f"coalesce(col_start, 0) div {BLOCK_COLUMNS}").alias("_c")]
    placed = F.struct("line_start", "col_start", "id", token.alias("t"))
    blocks = rows.groupBy("file_id", *block).agg(F.transform(F.array_sort(F.collect_set(placed)), lambda x: x["t"]).alias("own"))
    more = K + WINDOW - 2
    ahead = Window.partitionBy("file_id").orderBy("_b", "_c").rowsBetween(1, more)
    # Every block has a symbol, so that the next ``more`` blocks have enough between them.
    follows = F.slice(F.flatten(F.collect_list(F.slice("own", 1, more)).over(ahead)), 1, more)
    read = blocks.withColumn("follows", follows)

    @F.pandas_udf("array<long>")
    def prints(own: pd.Series, follows: pd.Series) -> pd.Series:
        return pd.Series([winnow(np.concatenate([a, b]).astype(np.int64).view(np.uint64), len(a)).view(np.int64) for a, b in zip(own, follows)])

    return read.select("file_id", F.explode(prints("own", "follows")).alias("print")).distinct()


def copied_files(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_id, n_prints, n_shared): files most of whose fingerprints recur in MIN_PROJECTS projects or more. paths: (file_id, path)."""
    prints = cut(fingerprints(symbols).join(paths.select("file_id", project(F.col("path")).alias("project")), "file_id"))
    spread = prints.select("print", "project").distinct().groupBy("print").agg(F.count("project").alias("n_projects")).where(F.col("n_projects") >= MIN_PROJECTS)
    shared = spread_join(prints.select("file_id", "print"), spread.select("print", F.lit(1).alias("_s")), ["print"], "left", ["file_id"])
    per = shared.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_prints"), F.count("_s").alias("n_shared"))
    return per.where((F.col("n_shared") >= COPIED_SHARE * F.col("n_prints")) & (F.col("n_prints") >= LEAST_PRINTS))


def not_handwritten(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, reason) of files that are not hand-written, each with all its reasons.

    reason is vendored, build, generated, bundled, data or copied. The path is asked first,
    the file's symbols where the path is silent, and fingerprints over all files: copied is
    a file whose fingerprints largely recur across unrelated projects. Files without rows
    in symbols are judged by path alone; null paths tell nothing; a file indexed several
    times is judged once, by its least path. Empty tables give no rows.
    """
    paths = first_seen(files).select("file_id", "path")
    by_path = paths.select("file_id", path_reason(F.col("path")).alias("reason"))
    told = by_path.where(F.col("reason").isNotNull())
    silent = by_path.where(F.col("reason").isNull()).select("file_id")
    by_shape = shape_reason(symbols).join(silent, "file_id", "left_semi").select("file_id", F.col("shape").alias("reason"))
    copied = copied_files(symbols, paths).select("file_id", F.lit("copied").alias("reason"))
    return reduce(DataFrame.unionByName, [told, by_shape, copied])
