import time

from codelode.operators import architecture, closure, search
from codelode.sources.index import FILE_SPAN, Index, dense_ids
from codelode.streaming.ingest import watch_index, watch_tree

TS = """// Adds two numbers.
function add(a, b) {
  return twice(a) + b;
}

class Shop {
  sell(item) {
    return add(item, 1);
  }
}
import { twice } from "./math";
"""
RS = "pub fn run() {\n    helper();\n}\npub struct Job {\n    id: u32,\n}\nfn helper() { }\n"


def listed(g, *columns):
    return sorted(tuple(r) for r in g.symbols.select(*columns).collect())


def test_index_edit_delete_and_query(spark, tmp_path):
    tree, index = tmp_path / "tree", Index(spark, str(tmp_path / "index"))
    assert index.graph().symbols.count() == 0
    tree.mkdir()
    (tree / "shop.ts").write_text(TS)
    (tree / "math.ts").write_text("export function twice(x) {\n  return x * 2;\n}\n")
    (tree / "job.rs").write_text(RS)
    assert index.refresh([str(tree)]) == {"indexed": 3, "skipped": 0}
    g = index.graph()
    ids = {r["path"].rsplit("/", 1)[-1]: r["id"] for r in g.files.collect()}
    assert sorted(ids.values()) == [1, 2, 3]
    rows = {r["name"]: r for r in g.symbols.collect()}
    assert set(rows) == {"add", "Shop", "sell", "twice", "run", "Job", "helper"}
    assert rows["sell"]["parent_symbol_id"] == rows["Shop"]["id"] and rows["add"]["docstring"] == "Adds two numbers."
    assert (rows["add"]["line_start"], rows["add"]["line_end"], rows["add"]["col_end"]) == (2, 4, 1) and rows["run"]["is_exported"] == 1
    assert all(r["id"] // FILE_SPAN == r["file_id"] for r in rows.values())
    assert [(r["from_symbol"], r["ref_col"]) for r in closure.references_to(g, "add", 1).collect()] == [("sell", 11)]
    assert {r["target"].rsplit("/", 1)[-1] for r in architecture.resolve(g).collect()} == {"math.ts"}
    # Nothing changed: nothing is parsed.
    assert index.refresh([str(tree)]) == {"indexed": 0, "skipped": 3}
    # One file edited, one new, one gone.
    (tree / "math.ts").write_text("export function twice(x) {\n  return x + x;\n}\nexport function thrice(x) {\n  return twice(x) + x;\n}\n")
    (tree / "new.ts").write_text("const later = () => thrice(1);\n")
    (tree / "job.rs").unlink()
    assert index.refresh([str(tree)], prune=True) == {"indexed": 2, "skipped": 1, "removed": 1}
    g = index.graph()
    again = {r["path"].rsplit("/", 1)[-1]: r["id"] for r in g.files.collect()}
    assert again == {"shop.ts": ids["shop.ts"], "math.ts": ids["math.ts"], "new.ts": 4}
    assert [n for n, in listed(g, "name")] == ["Shop", "add", "later", "sell", "thrice", "twice"]
    assert {r["from_symbol"] for r in closure.references_to(g, "twice", 2, limit=None).collect()} == {"add", "thrice", "sell", "later"}
    assert {r["relation"]: r["n"] for r in search.index_stats(g).collect()} == {"files": 3, "symbols": 6, "references": 4, "imports": 1}


def test_watching_a_tree_keeps_the_index(spark, tmp_path):
    tree, index = tmp_path / "tree", Index(spark, str(tmp_path / "index"))
    tree.mkdir()
    (tree / "a.py").write_text("def one():\n    return two()\n")
    (tree / "b.py").write_text("def two():\n    return 2\n")
    watch_tree(spark, [str(tree)], index.apply, str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert [n for n, in listed(index.graph(), "name")] == ["one", "two"]
    # The same batch again changes nothing; files rewritten in place and deleted are told by their listing.
    index.apply(spark.createDataFrame([(str(tree / "a.py"), "def one():\n    return two()\n")], "file string, content string"))
    (tree / "b.py").write_text("def three():\n    return one()\n")
    (tree / "c.py").write_text("def four():\n    return three()\n")
    (tree / "a.py").unlink()
    query = watch_index(index, [str(tree)], str(tmp_path / "ticks"))
    for _ in range(120):
        if [n for n, in listed(index.graph(), "name")] == ["four", "three"]:
            break
        time.sleep(1)
    query.stop()
    assert query.exception() is None
    assert [n for n, in listed(index.graph(), "name")] == ["four", "three"]
    assert [r["from_symbol"] for r in closure.references_to(index.graph(), "three", 1).collect()] == ["four"]


def test_equal_symbols_of_a_line_are_kept_once(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.update(spark.createDataFrame([("/x/a.ts", None, "h"), ("/x/b.ts", "", "h2"), ("/x/c.txt", "words", "h3")], "file string, content string, hash string"))
    assert index.graph().symbols.count() == 0 and index.graph().files.count() == 3


def test_dense_ids(spark):
    rows = spark.createDataFrame([(f"p{i:03d}",) for i in range(200)], "path string").repartition(5)
    got = {r["path"]: r["id"] for r in dense_ids(rows, "path", 7).collect()}
    assert got == {f"p{i:03d}": 7 + i for i in range(200)}
