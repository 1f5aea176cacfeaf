from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codelode.operators import architecture, closure, diffs, impact, intent, maintenance, render, search
from codelode.sources.graph import Graph

FILES = "id long, path string, hash string, indexed_at timestamp_ntz"
SYMBOLS = "id long, name string, kind string, file_id long, line_start int, line_end int, col_start int, col_end int, parent_symbol_id long, signature string, is_exported int, docstring string"
REFS = "id long, from_symbol_id long, to_symbol_name string, to_symbol_bare_name string, to_file_id long, kind string, line int, col int"
IMPORTS = "id long, file_id long, source_path string, imported_name string, local_name string, is_default int, is_namespace int, line int"
AT = datetime(2025, 1, 1)


def sym(i, name, kind, file, a, b, exported=0, doc=None):
    return (i, name, kind, file, a, b, 0, 1, None, f"{name}()", exported, doc)


def ref(i, owner, name, kind="call", line=1):
    return (i, owner, name, name.rsplit(".", 1)[-1], None, kind, line, 0)


@pytest.fixture(scope="module")
def g(spark):
    files = [(1, "src/orders.ts", "h", AT), (2, "src/utils.ts", "h", AT), (3, "src/api/index.ts", "h", AT), (1, "src/orders.ts", "h2", AT)]
    symbols = [
        sym(1, "processOrder", "function", 1, 1, 10, 1, "Processes an ORDER."), sym(2, "cancelOrder", "function", 1, 12, 20, 1), sym(3, "log", "function", 2, 1, 5), sym(4, "handleRequest", "function", 3, 1, 9, 1, "Handles."),
        sym(5, "Data", "class", 2, 10, 30, 1), sym(6, "loadData", "method", 2, 12, 15), sym(7, "datum", "variable", 2, 40, 40), sym(8, "loop", "function", 2, 50, 60), sym(3, "log", "function", 2, 1, 5),
    ]
    refs = [
        ref(1, 2, "processOrder", line=14), ref(2, 4, "processOrder", line=3), ref(3, 1, "log", line=2), ref(4, 2, "log.info", line=13), ref(5, 4, "util.log", line=4), ref(6, 8, "loop", line=51), ref(7, 6, "Data", "instantiation", 13),
        ref(8, 4, "LOG.warn", line=5), ref(9, 2, "log.log", line=15), ref(9, 2, "log.log", line=15),
    ]
    imports = [(1, 1, "./utils", "log", "log", 0, 0, 1), (2, 3, "../orders", "processOrder", "processOrder", 0, 0, 1), (3, 1, "./api", "*", "api", 0, 1, 2), (4, 2, "orders", "x", "x", 0, 0, 1), (5, 2, "./gone", "x", "x", 0, 0, 2)]
    return Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs, REFS), spark.createDataFrame(imports, IMPORTS))


def names(df, c="name"):
    return [r[c] for r in df.collect()]


def test_search(g):
    assert names(search.find_symbols(g, "data")) == ["Data", "loadData"]
    assert names(search.find_symbols(g, "Data", limit=1)) == ["Data"] and names(search.find_symbols(g, "Data", kind="method")) == ["loadData"]
    assert len(names(search.find_symbols(g, "dat_"))) == 3 and names(search.find_symbols(g, "\\")) == []
    assert names(search.search_docstrings(g, "order")) == ["processOrder"]
    assert names(search.exports_of(g, "src/orders.ts")) == ["processOrder", "cancelOrder"]
    assert {r["relation"]: r["n"] for r in search.index_stats(g).collect()} == {"files": 3, "symbols": 8, "references": 9, "imports": 5}
    assert names(search.endpoints(g)) == ["handleRequest"]
    assert [(r["path"], r["n_symbols"]) for r in search.largest_files(g, 1).collect()] == [("src/utils.ts", 5)]


def chains(g, root, depth):
    """Paths by brute force."""
    symbols = {r["id"]: r for r in g.placed.collect()}
    refs = g.references.collect()
    out, frontier = [], [root]
    for d in range(1, depth + 1):
        ahead = []
        for t in frontier:
            for r in refs:
                full = r["to_symbol_name"]
                if t in (full, r["to_symbol_bare_name"]) or full.lower().startswith(t.lower() + "."):
                    out.append((d, r["id"]))
                    ahead.append(symbols[r["from_symbol_id"]]["name"])
        frontier = ahead
    return sorted(out)


@pytest.mark.parametrize("root,depth", [("log", 3), ("loop", 4), ("processOrder", 2), ("nothing", 2), ("Data", 10)])
def test_reference_closure_counts_paths(g, root, depth):
    got = closure.references_to(g, root, depth, limit=None).collect()
    assert sorted((r["depth"], r["ref_id"]) for r in got for _ in range(r["paths"])) == chains(g, root, depth)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_path_counts_of_many_roots(g, spark, depth):
    """With a reference that meets a name in another case, and one that would meet it as bare name and before the dot."""
    roots = ["log", "LOG", "loop", "processOrder", "Data", "nothing", "util", None]
    got = closure.path_counts(g, spark.createDataFrame([(r,) for r in roots], "root string"), depth).collect()
    want = Counter((r, d) for r in roots if r for d, _ in chains(g, r, depth))
    assert {(r["root"], r["depth"]): r["n_paths"] for r in got} == want


def test_path_counts_keep_no_row_per_root_and_reference(spark, monkeypatch):
    """200 names that each of 20 symbols calls, which are called in turn: no level is written."""
    files = [(1, "a.ts", "h", AT)]
    symbols = [sym(i, f"n{i}", "interface", 1, i, i) for i in range(200)] + [sym(200 + i, f"c{i}", "function", 1, 300 + i, 300 + i) for i in range(20)]
    refs = [ref(1000 * (200 + i) + j, 200 + i, f"n{j}") for i in range(20) for j in range(200)] + [ref(j, 200 + j % 20, f"c{j % 7}") for j in range(200)]
    g = Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs, REFS), spark.createDataFrame([], IMPORTS))
    monkeypatch.setattr(closure, "cut", lambda df: pytest.fail("a level was written"))
    monkeypatch.setattr(closure, "cut_counted", closure.cut)
    rows = closure.path_counts(g, g.symbols.where("kind = 'interface'").select(F.col("name").alias("root")), 2).collect()
    second = sum(1 for i in range(20) for j in range(200) if j % 7 == i)
    assert sorted((r["root"], r["depth"], r["n_paths"]) for r in rows) == sorted((f"n{j}", d, n) for j in range(200) for d, n in ((1, 20), (2, second)))


def test_limit_cuts_paths(g):
    rows = closure.references_to(g, "loop", 10, limit=4).collect()
    assert [r["depth"] for r in rows] == [1, 2, 3, 4]
    assert "loop" in render.references_by_depth("loop", rows)


def test_callees_and_dependencies(g):
    got = closure.callee_closure(g, "handleRequest", 2).collect()
    assert sorted((r["depth"], r["callee"]) for r in got) == [(1, "LOG.warn"), (1, "processOrder"), (1, "util.log"), (2, "log")]
    assert "graph TD" in render.call_graph("handleRequest", [], got, mermaid=True)
    deps = closure.dependency_closure(g, "src/utils.ts", 2).collect()
    assert sorted((r["depth"], r["file"], r["source"]) for r in deps) == [(1, "src/utils.ts", "./gone"), (1, "src/utils.ts", "orders"), (2, "src/orders.ts", "./api"), (2, "src/orders.ts", "./utils")]


def test_impact(g):
    rows = {r["name"]: r for r in impact.change_impact(g, "src/orders.ts", 5, 12, 2).collect()}
    assert set(rows) == {"processOrder", "cancelOrder"} and (rows["processOrder"]["direct"], rows["processOrder"]["n_files"]) == (2, 2)
    assert "processOrder" in render.impact_report(rows.values())


DIFF = """diff --git a/src/orders.ts b/src/orders.ts
--- a/src/orders.ts
+++ b/src/orders.ts
@@ -2,3 +2,4 @@ fn
 context
-old
+new
+newer
\\ No newline at end of file
@@ -30 +31,2 @@
+tail
diff --git a/old.ts b/src/utils.ts
rename from old.ts
rename to src/utils.ts
diff --git a/src/api/index.ts b/src/api/index.ts
deleted file mode 100644
--- a/src/api/index.ts
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
"""


def test_diffs(g, spark):
    lines = diffs.diff_lines(spark.createDataFrame([("d", DIFF), ("crlf", DIFF.replace("\n", "\r\n")), ("none", ""), ("null", None)], "diff_id string, diff_text string"))
    sections = diffs.diff_files(lines)
    for d in ("d", "crlf"):
        got = [(r["new_file"], r["status"], r["added"], r["removed"], r["line_min"], r["line_max"]) for r in sections.where(f"diff_id = '{d}'").orderBy("section").collect()]
        assert got == [("src/orders.ts", "modified", [3, 4, 31], [3], 3, 31), ("src/utils.ts", "renamed", [], [], 1, 1), ("/dev/null", "deleted", [], [1, 2], 1, 2)]
    assert sections.where("diff_id IN ('none', 'null')").count() == 0
    affected = diffs.affected_symbols(g, sections.where("diff_id = 'd'"))
    assert sorted((r["change"], r["name"]) for r in affected.collect()) == [("modified", "cancelOrder"), ("modified", "log"), ("modified", "processOrder"), ("removed", "handleRequest")]
    risks = {r["name"]: (r["total"], r["risk"]) for r in diffs.diff_impact(g, affected, 2).collect()}
    assert risks["handleRequest"] == (0, "none") and risks["log"][1] == "high"


def test_whole_files_give_all_symbols(spark):
    files = [(1, "gone.ts", "h", AT), (2, "new.ts", "h", AT), (3, "user.ts", "h", AT)]
    symbols = [sym(100 * f + i, f"f{f}_{i}", "function", f, i, i) for f, n in ((1, 99), (2, 99)) for i in range(1, n + 1)] + [sym(1000 + 100 * f + i, f"g{f}_{i}", "function", f, 200 + i, 200 + i) for f in (1, 2) for i in range(31)] + [sym(9000, "user", "function", 3, 1, 9)]
    refs = [ref(1, 9000, "g1_30"), ref(2, 9000, "f1_1")]
    g = Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs, REFS), spark.createDataFrame([], IMPORTS))
    text = "diff --git a/gone.ts b/gone.ts\n--- a/gone.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\ndiff --git a/new.ts b/new.ts\n--- /dev/null\n+++ b/new.ts\n@@ -0,0 +1 @@\n+a"
    sections = diffs.diff_files(diffs.diff_lines(spark.createDataFrame([("d", text)], "diff_id string, diff_text string")))
    rows = diffs.diff_impact(g, diffs.affected_symbols(g, sections), 1).collect()
    assert sorted(r["change"] for r in rows) == ["added"] * 130 + ["removed"] * 130
    assert sorted(r["name"] for r in rows if r["risk"] == "breaking") == ["f1_1", "g1_30"]


@pytest.mark.parametrize("many", [False, True])
def test_direct_counts_leave_out_a_symbols_own_references(spark, many):
    """Two files of one path, one without a path, names with a dot and in two cases, references within the symbol itself."""
    files = [(1, "a.ts", "h", AT), (2, "a.ts", "h", AT), (3, "b.ts", "h", AT), (4, None, "h", AT)]
    symbols = [sym(1, "run", "function", 1, 1, 9), sym(2, "run", "function", 2, 1, 9), sym(3, "run", "function", 3, 1, 9), sym(4, "Run", "class", 3, 10, 19), sym(5, "a.b", "function", 3, 20, 29), sym(6, "run", "function", 4, 1, 9), sym(7, "go", "function", 4, 10, 19), sym(8, None, "function", 3, 30, 39), sym(1, "run", "function", 1, 1, 9)]
    callees = ["run", "Run.run", "run.x.y", "a.b", "A.b.c", "x.RUN", "run.Run", "other"]
    refs = [(10 * s + i, s, c, None if (s + i) % 7 == 0 else "" if (s + i) % 7 == 1 else c.rsplit(".", 1)[-1], None, "call", 1, 0) for s in range(1, 9) for i, c in enumerate(callees)]
    g = Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs + refs[:9], REFS), spark.createDataFrame([], IMPORTS))
    paths, owner = {f: p for f, p, *_ in files}, {s[0]: s for s in symbols}
    changed = [(s[0], s[1], paths[s[3]]) for s in owner.values() if paths[s[3]]]
    want = {}
    for i, name, file in changed:
        met = [r for r in refs if name and (name in (r[2], r[3]) or r[2].lower().startswith(name.lower() + "."))]
        met = [paths[owner[r[1]][3]] for r in met if owner[r[1]][1] not in (name, None) or paths[owner[r[1]][3]] not in (file, None)]
        want[i] = (len(met), len({f for f in met if f}))
    rows = impact.with_direct_counts(g, spark.createDataFrame(changed, "id long, name string, file string"), many).collect()
    assert {r["id"]: (r["total"], r["n_files"]) for r in rows} == want and len(rows) == len(changed)


def test_impact_of_common_names_meets_no_pairs(spark, monkeypatch):
    """300 symbols of one name, referred to from 300 files: no row per symbol and reference is made."""
    monkeypatch.setattr(impact, "reference_closure", lambda *_: pytest.fail("references were listed per symbol"))
    files = [(i, f"f{i}.ts", "h", AT) for i in range(300)]
    symbols = [sym(i, "run", "function", i, 1, 9) for i in range(300)]
    g = Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([ref(i, i, "run") for i in range(300)], REFS), spark.createDataFrame([], IMPORTS))
    affected = g.placed.select(F.lit("d").alias("diff_id"), F.lit(1).alias("section"), F.lit("removed").alias("change"), "id", "name", "kind", "file", "is_exported")
    rows = diffs.diff_impact(g, affected, 1).collect()
    assert {(r["direct"], r["total"], r["n_files"], r["risk"]) for r in rows} == {(299, 299, 299, "breaking")} and len(rows) == 300


def test_definitions_follow_imports(spark):
    files = [(i, f"src/{p}.ts", "h", AT) for i, p in enumerate(["any", "near", "user", "other"], 1)]
    symbols = [
        sym(1, "log", "function", 1, 1, 2, 1), sym(2, "log", "function", 2, 1, 2, 1), sym(3, "user", "function", 3, 1, 9), sym(4, "other", "function", 4, 1, 9), sym(5, "save", "function", 1, 3, 4, 1), sym(6, "save", "function", 2, 3, 4), sym(7, "keep", "function", 1, 5, 6, 1),
        sym(8, "run", "function", 1, 7, 8, 1), sym(9, "run", "function", 2, 7, 8, 1), sym(10, "run", "function", 3, 10, 11),
    ]
    refs = [ref(1, 3, "log"), ref(2, 4, "log"), ref(3, 3, "keep"), ref(4, 3, "run"), ref(5, 3, "save"), ref(6, 3, "nothing")]
    imports = [(1, 3, "./near", "log", "log", 0, 0, 1), (2, 3, "./near", "save", "keep", 0, 0, 2), (3, 3, "./near", "run", "run", 0, 0, 3), (4, 4, "./gone", "log", "log", 0, 0, 1)]
    g = Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs, REFS), spark.createDataFrame(imports, IMPORTS))
    assert {r["ref_id"]: r["definition_id"] for r in search.definitions(g).collect()} == {1: 2, 2: 1, 3: 6, 4: 10, 5: 5, 6: None}


def test_architecture(g):
    edges = {(r["source_file"], r["target_file"]) for r in architecture.module_edges(g).collect()}
    assert edges == {("src/orders.ts", "src/utils.ts"), ("src/api/index.ts", "src/orders.ts"), ("src/orders.ts", "src/api/index.ts"), ("src/utils.ts", "src/orders.ts")}
    assert architecture.modules_without_edges(g).count() == 0
    dirs = architecture.directory_edges(g, depth=2).collect()
    assert {(r["source_dir"], r["target_dir"], r["n_edges"]) for r in dirs} == {("src/api", "src", 1), ("src", "src/api", 1)}
    assert "graph LR" in render.module_diagram(dirs, architecture.directory_groups(g).collect())


def test_upkeep(g, spark):
    scanned = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "0"), ("z", "9")], "path string, hash string")
    assert {r["path"]: r["state"] for r in maintenance.split_by_hash(scanned, known).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert names(maintenance.vanished(scanned, known), "path") == ["z"]
    tables = {"files": g.files, "symbols": g.symbols, "references": g.references, "imports": g.imports}
    left = maintenance.without_files(tables, spark.createDataFrame([(2,)], "file_id long"))
    assert {r["relation"]: r["n"] for r in maintenance.table_counts(left).collect()} == {"files": 2, "symbols": 3, "references": 7, "imports": 3}
    parsed = {k: v.limit(0) for k, v in tables.items()} | {"files": g.files.where("id = 2"), "symbols": g.symbols.where("id = 3")}
    new = maintenance.replace_files(tables, parsed)
    assert {r["relation"]: r["n"] for r in maintenance.table_counts(new).collect()} == {"files": 3, "symbols": 4, "references": 7, "imports": 3}


@pytest.mark.parametrize(
    "question,want",
    [
        ("show all api routes", "find_endpoints"), ("which classes are in auth", "find_classes"), ("list interfaces", "find_interfaces"), ("functions in utils.ts", "find_functions"), ("what is exported? the exports", "find_exports"),
        ("what does orders.ts import", "dependency_of"), ("consumers of `log`", "dependents_of"), ("who uses `log`", "dependency_of"), ("describe the router", "module_summary"), ("where is the entry point", "entry_points"), ("largest files", "largest_files"), ("foo bar", "symbol_search"), ("", "symbol_search"),
    ],
)
def test_intents(spark, question, want):
    assert intent.understand(question)[0] == want
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(intent.classify(df["q"])).first()[0] == want


def test_answers(g):
    assert names(intent.answer(g, "largest files"), "path")[0] == "src/utils.ts"
    assert "processOrder" in names(intent.answer(g, "functions in orders"))


def test_empty_graph(spark):
    none = Graph(*(spark.createDataFrame([], s) for s in (FILES, SYMBOLS, REFS, IMPORTS)))
    assert search.find_symbols(none, "x").count() == 0 and closure.references_to(none, "x", 3).count() == 0 and architecture.module_edges(none).count() == 0
