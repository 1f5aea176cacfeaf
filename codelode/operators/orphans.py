"""References to rows that do not exist, or came later than the referring row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.paths import directory, normalise
from codelode.operators.skew import heavy_counted, spread_join
from codelode.session import cut
from codelode.sources.tables import first_seen

# What may follow an import's resolved path, in the order tried.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", "/index.ts", "/index.js", "/index.tsx"]


def null_masks(child: DataFrame, keys: list[str]) -> list[tuple[list[str], Column]]:
    """Each pattern of nulls over the key columns: (columns that are not null, condition)."""
    out = []
    for present in product([True, False], repeat=len(keys)):
        cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() if p else F.col(k).isNull() for k, p in zip(keys, present)])
        out.append(([k for k, p in zip(keys, present) if p], cond))
    return out


def find_orphans(
    child: DataFrame,
    row_id: str | list[str],
    parent: DataFrame,
    keys: list[tuple[str, str]],
    match: str = "simple",
    times: tuple[str, str] | None = None,
    forms: dict[str, Callable[[Column], Column]] | None = None,
    carry: list[str] = (),
    masks: list[list[str]] | None = None,
) -> DataFrame:
    """The child's rows (row id, key columns, ``carry``) whose key is missing in the parent.

    keys pairs the columns of child and parent. Rows are grouped by which key columns are
    null, and each group is anti-joined on its other columns. A key with nulls is judged
    as declared by ``match``, in SQL's sense: ``simple`` never calls it an orphan,
    ``partial`` asks that some parent agrees on the columns that are not null, ``full``
    calls it an orphan unless all columns are null. All-null keys are never orphans.

    ``times`` names a time of the child and one of the parent: a parent that came after the
    child's row is not there yet for it. Where either time is null the parent is there.
    ``forms`` gives a key column a second form, such as the last part of a dotted name: a
    key is there if it is there in either form. ``masks`` names the sets of non-null key
    columns that occur, if that is known, so that the others need not be looked for.

    The anti-join runs over distinct keys, whose rows are then fetched by a salted join, so
    that a key held by a third of the rows costs as much as any other. Keys without any
    time are judged once for all their rows, those with times once per time. Rows
    delivered twice come out once; an empty parent makes every judged row an orphan.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"no such match semantics: {match}")
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    names = [c for c, _ in keys]
    out = [*ids, *names, *carry]
    at, there_at = times or (None, None)
    rows = child.select(*dict.fromkeys([*out, *([at] if at else [])]))
    parts = []
    for present, cond in null_masks(rows, names):
        if not present or (len(present) < len(names) and match == "simple") or (masks is not None and present not in masks):
            continue
        own = rows.where(cond)
        if len(present) < len(names) and match == "full":
            parts.append(own.select(*out))
            continue
        there = parent.select(*[F.col(p).alias(c) for c, p in keys if c in present], *([there_at] if times else [])).dropna(subset=present)
        if times:
            # Parents without a time are always there, others from the first of them on.
            there = there.groupBy(*present).agg(F.when(F.count(F.lit(1)) == F.count(there_at), F.min(there_at)).alias("_from"))
        else:
            there = there.distinct()
        judged = [*present, *([F.col(at).alias("_at")] if times else [])]
        counted = cut(own.groupBy(*judged).agg(F.count(F.lit(1)).alias("_n")))
        missing = _not_there(counted, there, present, bool(times))
        for k, form in (forms or {}).items():
            if k in present:
                # What is missing in its own form is asked for again in the other.
                again = missing.withColumn("_own", F.col(k)).withColumn(k, form(F.col(k)))
                missing = _not_there(again, there, present, bool(times)).withColumn(k, F.col("_own")).drop("_own")
        missing = missing.drop("_n")
        on = list(present)
        if times:
            # A null time is a key like any other here, so it is told apart by a flag.
            own = own.withColumn("_at", F.coalesce(F.col(at).cast("string"), F.lit("")))
            counted = counted.withColumn("_at", F.coalesce(F.col("_at").cast("string"), F.lit("")))
            missing = missing.withColumn("_at", F.coalesce(F.col("_at").cast("string"), F.lit("")))
            on.append("_at")
        parts.append(spread_join(own, missing, on, "left_semi", ids, known=(heavy_counted(counted, on, "_n"),)).select(*out))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else rows.select(*out).limit(0)


def _not_there(keys: DataFrame, there: DataFrame, on: list[str], timed: bool) -> DataFrame:
    """The keys that no parent has, or only later than ``_at``."""
    if not timed:
        return keys.join(there, on, "left_anti")
    held = keys.join(there.withColumn("_there", F.lit(True)), on, "left")
    return held.where(F.col("_there").isNull() | (F.col("_from") > F.col("_at"))).drop("_there", "_from")


def referring_files(refs: DataFrame, symbols: DataFrame, seen: DataFrame) -> DataFrame:
    """refs plus ``ref_at``, the first time of the file that holds the referring symbol (null if unknown). Symbols delivered twice give equal rows twice."""
    owner = symbols.select(F.col("id").alias("from_symbol_id"), F.col("file_id").alias("_file")).dropna()
    placed = cut(spread_join(refs, owner, ["from_symbol_id"], "left", ["id"]))
    return spread_join(placed, seen.select(F.col("file_id").alias("_file"), F.col("first_at").alias("ref_at")), ["_file"], "left", ["id"]).drop("_file")


def based_imports(imports: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, ref_at, _base) of the relative imports: the importing file's directory plus the import, normalised. Imports of unknown files are dropped."""
    rel = imports.where(F.col("source_path").rlike(r"^\.\.?/") & F.col("file_id").isNotNull()).select("id", "file_id", "source_path")
    at = seen.select("file_id", F.col("path").alias("_from"), F.col("first_at").alias("ref_at"))
    rel = spread_join(rel, at, ["file_id"], "inner", ["id"])
    base = normalise(F.concat(directory(F.col("_from")), F.lit("/"), F.col("source_path")))
    return rel.withColumn("_base", base).select("id", "ref_at", "_base")


def import_targets(seen: DataFrame) -> DataFrame:
    """(_base, target, target_at): per resolved path the file it leads to, the first hit among the path itself, the path plus each extension, and its index files.

    Every file path is cut by the suffixes it ends in and met on what is left, which gives
    few rows per file instead of twelve per import.
    """
    path = F.col("path")
    cuts = [F.when(path.endswith(s), F.struct(F.expr(f"left(path, length(path) - {len(s)})").alias("_base"), F.lit(i).alias("_rank"))) for i, s in enumerate(SUFFIXES)]
    paths = seen.groupBy("path").agg(F.min("first_at").alias("target_at"))
    ends = paths.select("path", "target_at", F.explode(F.array_compact(F.array(*cuts))).alias("h")).select("h._base", "h._rank", "path", "target_at")
    first = F.min_by(F.struct("path", "target_at"), F.col("_rank")).alias("t")
    return ends.groupBy("_base").agg(first).select("_base", F.col("t.path").alias("target"), "t.target_at")


def resolve_imports(imports: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, ref_at, target, target_at) of the relative imports: the file each resolves to, null if none."""
    rel = cut(based_imports(imports, seen))
    return spread_join(rel, import_targets(seen), ["_base"], "left", ["id"]).select("id", "ref_at", "target", "target_at")


def index_references(files: DataFrame, symbols: DataFrame, refs: DataFrame, imports: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, parent): all references of the index by one composite key, and what there is to refer to.

    child: field, row_id, owner, at, name, file_id, base. The key is (name, file_id, base),
    of which each field fills one column and leaves the others null: ``to_symbol_name`` the
    name, ``to_file_id`` the file, ``source_path`` the resolved path without its ending. at
    is the first time of the referring file where the field asks for it, owner the
    referring symbol where it does not. parent: name, file_id, base, came.
    """
    none = {"owner": "bigint", "at": "timestamp_ntz", "name": "string", "file_id": "bigint", "base": "string"}

    def shaped(df: DataFrame, field: str, **cols: Column) -> DataFrame:
        filled = [cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()]
        return df.select(F.lit(field).alias("field"), F.col("id").cast("long").alias("row_id"), *filled)

    to_file = refs.select("id", "from_symbol_id", "to_file_id").where(F.col("to_file_id").isNotNull())
    dated = cut(referring_files(to_file, symbols, seen))
    relative = cut(based_imports(imports, seen))
    child = reduce(
        DataFrame.unionByName,
        [
            shaped(refs, "to_symbol_name", owner=F.col("from_symbol_id"), name=F.col("to_symbol_name")),
            shaped(dated, "to_file_id", at=F.col("ref_at"), file_id=F.col("to_file_id")),
            shaped(relative, "source_path", at=F.col("ref_at"), base=F.col("_base")),
        ],
    )
    there = {"name": "string", "file_id": "bigint", "base": "string", "came": "timestamp_ntz"}

    def named(df: DataFrame, **cols: str) -> DataFrame:
        return df.select(*[(F.col(cols[c]) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in there.items()])

    targets = import_targets(seen)
    parent = named(symbols, name="name").unionByName(named(seen, file_id="file_id", came="first_at")).unionByName(named(targets, base="_base", came="target_at"))
    return child, parent


def _orphans(files: DataFrame, symbols: DataFrame, refs: DataFrame, imports: DataFrame, seen: DataFrame, match: str) -> DataFrame:
    child, parent = index_references(files, symbols, refs, imports, seen)
    keys = [(k, k) for k in ("name", "file_id", "base")]
    bare = {"name": lambda c: F.substring_index(c, ".", -1)}
    return find_orphans(child, ["field", "row_id"], parent, keys, match, ("at", "came"), bare, ["owner", "at"], masks=[["name"], ["file_id"], ["base"]])


def index_orphans(files: DataFrame, symbols: DataFrame, refs: DataFrame, imports: DataFrame, match: str = "partial") -> DataFrame:
    """(field, row_id) of references to names, files and import targets that are missing or came later.

    Distinct rows. All three fields go through ``find_orphans`` as one composite key, each
    with its own null mask; under partial match a mask is judged by the column it fills. A
    null ``to_symbol_name``, ``to_file_id`` or ``source_path`` refers to nothing. A target
    came later if its file was first indexed after the referring row's file; where either
    time is unknown, it did not. Rows without an id are left out.
    """
    found = _orphans(files, symbols, refs, imports, cut(first_seen(files)), match)
    return found.select("field", "row_id").where(F.col("row_id").isNotNull()).distinct()


def orphans_by_month(files: DataFrame, symbols: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """(table_name, field, month, n_orphans): orphans per table, field and month of the referring file's first indexing.

    The month is ``yyyy-MM``, null if the referring file is unknown.
    """
    seen = cut(first_seen(files))
    found = cut(_orphans(files, symbols, refs, imports, seen, "partial").where(F.col("row_id").isNotNull()))
    by_name = found.where(F.col("field") == "to_symbol_name").select("field", F.col("row_id").alias("id"), F.col("owner").alias("from_symbol_id"))
    dated = referring_files(by_name, symbols, seen).select("field", "id", "ref_at").distinct().select("field", "ref_at")
    both = dated.unionByName(found.where(F.col("field") != "to_symbol_name").select("field", F.col("at").alias("ref_at")))
    table = F.when(F.col("field") == "source_path", "imports").otherwise("references_")
    return both.groupBy(table.alias("table_name"), "field", F.date_format("ref_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
