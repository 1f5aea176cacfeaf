import numpy as np

from codelode.llm.handwritten import K, WINDOW, fingerprints, not_handwritten, winnow

FILES = "id long, path string, hash string, indexed_at timestamp_ntz, reason string"
SYMBOLS = "id long, name string, kind string, file_id long, line_start int, line_end int, col_start int, col_end int, signature string, docstring string, shape int"

FLAGGED = {
    "/srv/code/p/third_party/x/a.c": "vendored", "\\srv\\code\\p\\Vendor\\x\\a.c": "vendored", "/srv/code/p/lib/.venv/lib/a.py": "vendored", "/srv/code/p/dist/a.js": "build",
    "/srv/code/p/cmake-build-debug/a.c": "build", "/srv/code/p/gen/A.java": "generated", "/srv/code/p/a_pb2.py": "generated", "/srv/code/p/a.pb.go": "generated", "/srv/code/p/a.generated.ts": "generated",
    "/srv/code/p/lex.a.c": "generated", "/srv/code/p/a.min.js": "bundled", "/srv/code/p/core-min.js": "bundled", "/srv/code/p/static/js/main.5cdb0de4.js": "bundled",
}
PLAIN = [
    "/srv/code/p/vendor-portal/a.c", "/srv/code/p/deps-audit/a.c", "/srv/code/p/dist-lock/a.c", "/srv/code/p/src/generator.py", "/srv/code/p/src/min_heap.js", "/srv/code/p/src/minimap.ts", "/srv/code/p/src/vendored_check.go",
    "/srv/code/p/src/codegen6.rs", "/srv/code/vendor/src/a.c", "/srv/dist/p/src/a.c", "", "a.c",
]


def test_paths(spark):
    rows = [(i, p, "h", None, "x") for i, p in enumerate([*FLAGGED, *PLAIN, None])]
    rows += rows[:3]
    got = {r["file_id"]: r["reason"] for r in not_handwritten(spark.createDataFrame(rows, FILES), spark.createDataFrame([], SYMBOLS)).collect()}
    assert got == dict(enumerate(FLAGGED.values()))


def test_shapes_where_the_path_is_silent(spark):
    files = [(i, f"/srv/code/p{i}/src/f.js", "h", None, "x") for i in range(1, 7)]
    symbols = [
        (1, "a", "function", 1, 1, 1, 10, 20, "a()", None, 0), (2, "b", "variable", 1, 1, 1, 4000, 4100, None, None, 0),  # minified
        (3, "table", "variable", 2, 3, 9000, 0, 1, None, None, 0),  # data
        (4, "f", "function", 3, 1, 5, 0, 40, "f()", "This file was generated automatically; changes will be lost.", 0), (5, "g", "function", 3, 9, 12, 0, 40, "g()", "Reads.", 0),  # generated
        (6, "h", "function", 4, 1, 9000, 0, 40, "h()", "Auto-generated method stub", 0), (7, "i", "variable", 4, 2, 8000, 0, 40, None, None, 0),  # long, but code
        (8, "one", "function", 5, 1, 5, 0, 40, "one()", "Reads.", 0), (9, "two", "function", 5, 9, 12, 0, 40, "two()", "Code generated by x. DO NOT EDIT.", 0),  # a note, not the file's
        (10, None, None, 6, None, None, None, None, None, None, 0), (11, "z", "function", None, 1, 1, 0, 1, None, None, 0),
    ]
    got = {(r["file_id"], r["reason"]) for r in not_handwritten(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS)).collect()}
    assert got == {(1, "bundled"), (2, "data"), (3, "generated")}


def test_copies_across_projects(spark):
    files, symbols, n = [], [], 0
    for f in range(1, 6):
        files.append((f, f"/srv/code/p{f}/src/f.py", "h", None, "x"))
        for i in range(30):
            n += 1
            own = f >= 4 or i == 7
            symbols.append((n, f"fun{i}" if not own else f"own{f}_{i}", "function", f, 10 * i, 10 * i + 5, 0, 9, f"fun{i}(a, b)" if not own else f"own{f}(a)", None, 0))
    symbols += symbols[:10]
    got = {(r["file_id"], r["reason"]) for r in not_handwritten(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS)).collect()}
    assert got == {(1, "copied"), (2, "copied"), (3, "copied")}


def test_empty(spark):
    assert not_handwritten(spark.createDataFrame([], FILES), spark.createDataFrame([], SYMBOLS)).count() == 0


def stream(n, file, lines, columns=None, names=None):
    return [(n + i, (names or [f"fun{j}" for j in range(len(lines))])[i], "function", file, line, line, columns[i] if columns else 0, 9, "f()", None, 0) for i, line in enumerate(lines)]


def test_prints_do_not_depend_on_block_edges(spark):
    # The same symbols close together, far apart, below a licence header, and on one long line.
    near, far, shifted = list(range(1, 61)), [1 + 100 * i for i in range(60)], [38 + 100 * i for i in range(60)]
    symbols = stream(0, 1, near) + stream(100, 2, far) + stream(200, 3, shifted) + stream(300, 4, [1] * 60, [1000 * i for i in range(60)]) + stream(400, 5, [1, 5000, 9000]) + stream(500, 6, [1, 5000, 9000, 20000])
    symbols += symbols[:20]
    got = {}
    for r in fingerprints(spark.createDataFrame(symbols, SYMBOLS)).collect():
        got.setdefault(r["file_id"], set()).add(r["print"])
    assert got[1] == got[2] == got[3] == got[4] and 5 not in got and len(got[6]) == 1


def test_winnowing_guarantees_a_shared_print():
    rng = np.random.default_rng(4)
    for _ in range(50):
        common = rng.integers(1, 2**63, K + WINDOW - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(1, 2**63, rng.integers(0, 30)).astype(np.uint64), common, rng.integers(1, 2**63, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        assert set(winnow(a, len(a))) & set(winnow(b, len(b)))


def test_a_copy_below_a_licence_header_is_found(spark):
    files = [(i, f"/srv/code/p{i}/src/f.py", "h", None, "x") for i in range(1, 5)]
    symbols = [row for f in (1, 2, 3) for row in stream(1000 * f, f, [37 * (f - 1) + 50 * i + 1 for i in range(40)])] + stream(9000, 4, [50 * i for i in range(40)], names=[f"own{i}" for i in range(40)])
    got = {(r["file_id"], r["reason"]) for r in not_handwritten(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS)).collect()}
    assert got == {(1, "copied"), (2, "copied"), (3, "copied")}
