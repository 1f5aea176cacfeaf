from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codelode.operators.orphans import find_orphans, index_orphans, orphans_by_month, resolve_imports
from codelode.sources.tables import first_seen

FILES = "id long, path string, hash string, indexed_at timestamp_ntz"
SYMBOLS = "id long, name string, file_id long"
REFS = "id long, from_symbol_id long, to_symbol_name string, to_file_id long, salt int"
IMPORTS = "id long, file_id long, source_path string"
T = [datetime(2025, m, 1) for m in range(1, 7)]


def tables(spark, empty=False):
    files = [(1, "/p/a/x.ts", "h", T[1]), (1, "/p/a/x.ts", "h2", T[3]), (2, "/p/a/y.ts", "h", T[0]), (3, "/p/b/index.ts", "h", T[4]), (4, "/p/b/z.ts.js", "h", T[0]), (5, None, None, None)]
    symbols = [(10, "f", 1), (11, "g", 2), (11, "g", 2), (12, None, 1), (13, "h", 77)]
    refs = [(1, 10, "f", None, 0), (2, 10, "obj.g", 2, 0), (3, 10, "nope", 3, 0), (3, 10, "nope", 3, 0), (4, 11, None, 9, 0), (5, 11, "F", 1, 0), (6, 13, "a.b.", 3, 0), (7, 11, "", None, 0)]
    imports = [(1, 1, "./y"), (2, 1, "../b"), (3, 2, "./x"), (4, 1, "pkg"), (5, 1, "../b/z.ts"), (6, 1, "./gone"), (6, 1, "./gone"), (7, 1, None), (8, None, "./y"), (9, 1, ".././a/./y.ts")]
    if empty:
        files = symbols = refs = imports = []
    return spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs, REFS), spark.createDataFrame(imports, IMPORTS)


def test_fields(spark):
    got = {(r["field"], r["row_id"]) for r in index_orphans(*tables(spark)).collect()}
    assert got == {
        ("to_symbol_name", 3), ("to_symbol_name", 5), ("to_symbol_name", 6), ("to_symbol_name", 7),
        ("to_file_id", 3), ("to_file_id", 4), ("to_file_id", 5),
        ("source_path", 2), ("source_path", 3), ("source_path", 6),
    }


def test_first_hit_decides(spark):
    files, _, _, imports = tables(spark)
    got = {r["id"]: r["target"] for r in resolve_imports(imports, first_seen(files)).collect()}
    assert got == {1: "/p/a/y.ts", 2: "/p/b/index.ts", 3: "/p/a/x.ts", 5: "/p/b/z.ts.js", 6: None, 9: "/p/a/y.ts"}


def test_months(spark):
    got = {(r["table_name"], r["field"], r["month"]): r["n_orphans"] for r in orphans_by_month(*tables(spark)).collect()}
    assert got[("imports", "source_path", "2025-02")] == 2 and got[("references_", "to_symbol_name", None)] == 1
    assert sum(got.values()) == 10


def test_empty(spark):
    assert index_orphans(*tables(spark, empty=True)).count() == 0
    assert orphans_by_month(*tables(spark, empty=True)).count() == 0


@pytest.mark.parametrize("match,want", [("simple", {3}), ("partial", {3, 5, 7}), ("full", {3, 4, 5, 6, 7})])
def test_match_semantics(spark, match, want):
    child = spark.createDataFrame([(1, "a", 1), (2, None, None), (3, "a", 2), (4, "a", None), (5, "z", None), (6, None, 1), (7, None, 9), (1, "a", 1)], "id long, x string, y long")
    parent = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), (None, 5, 0)], "name string, file long, id long")
    assert {r["id"] for r in find_orphans(child, "id", parent, [("x", "name"), ("y", "file")], match).collect()} == want


def test_hot_key(spark):
    child = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, x string")
    parent = spark.createDataFrame([("k0",)], "name string")
    assert find_orphans(child, "id", parent, [("x", "name")]).count() == 299


def test_fields_go_through_the_masks(spark):
    # Under simple match a composite key with nulls is never an orphan, under full match always: so the masks decide.
    assert index_orphans(*tables(spark), match="simple").count() == 0
    everything = {(r["field"], r["row_id"]) for r in index_orphans(*tables(spark), match="full").collect()}
    assert everything > {(r["field"], r["row_id"]) for r in index_orphans(*tables(spark)).collect()}
    assert ("to_file_id", 2) in everything and ("to_symbol_name", 4) not in everything


def test_times_and_forms(spark):
    child = spark.createDataFrame([(1, "a", T[0]), (2, "a", T[2]), (3, "a", None), (4, "x.a", T[5]), (5, "z", None), (6, "b", T[0]), (6, "b", T[0]), (7, "c", T[0])], "id long, k string, at timestamp_ntz")
    parent = spark.createDataFrame([("a", T[3]), ("a", T[1]), ("b", None), ("c", T[4]), ("c", None)], "name string, came timestamp_ntz")
    keys = [("k", "name")]
    assert {r["id"] for r in find_orphans(child, "id", parent, keys, times=("at", "came")).collect()} == {1, 4, 5}
    last = {"k": lambda c: F.substring_index(c, ".", -1)}
    assert {r["id"] for r in find_orphans(child, "id", parent, keys, times=("at", "came"), forms=last).collect()} == {1, 5}
