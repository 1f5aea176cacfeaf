"""Queries over the code graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.paths import normalise
from codelode.operators import architecture, closure, diffs, extract, impact, intent, maintenance, render, search
from codelode.sources.graph import Graph
from codelode.session import shared_folder
from codelode.sources.index import Index
from codelode.sources.tables import latest, load
from codelode.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_G = """g_files AS (SELECT id, min(path) AS path FROM files WHERE id IS NOT NULL GROUP BY id), g_symbols AS (SELECT DISTINCT * FROM symbols), g_refs AS (SELECT DISTINCT * FROM references_), g_imports AS (SELECT DISTINCT * FROM imports),
 placed AS (SELECT s.*, f.path AS file FROM g_symbols s JOIN g_files f ON f.id = s.file_id)"""
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(c: str) -> str:
    return f"translate({c}, '{_A}', '{_Z}')"


def _has(c: str, text: str) -> str:
    return f"{_fold(c)} LIKE '%{text.lower()}%'"


def query(sql: str | None = None, graph: bool = True):
    """Register a function of (graph) or (spark, folder) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, folder: f(Graph.read(spark, folder))) if graph else f
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {_G} {sql}"
        return f

    return add


_SHOWN = "id, name, kind, file, line_start, line_end, col_start, col_end, signature, is_exported, docstring"
_PATH = "(SELECT file FROM placed GROUP BY file ORDER BY count(*) DESC, file LIMIT 1)"


def _largest(g: Graph) -> str:
    """The path of the file with most symbols, which the one-file queries ask about."""
    return g.placed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").first()[0]


@query("SELECT 'files' AS relation, count(*) AS n FROM g_files UNION ALL SELECT 'symbols', count(*) FROM g_symbols UNION ALL SELECT 'references', count(*) FROM g_refs UNION ALL SELECT 'imports', count(*) FROM g_imports")
def index_stats(g):
    return search.index_stats(g)


@query(f"SELECT {_SHOWN} FROM placed WHERE {_has('name', 'commit')} ORDER BY CASE WHEN name = 'commit' THEN 0 ELSE 1 END, is_exported DESC, file, line_start, id LIMIT 20")
def find_symbol_contains(g):
    return search.find_symbols(g, "commit", limit=20)


@query(f"SELECT {_SHOWN} FROM placed WHERE {_has('name', 'scan')} AND kind = 'class' ORDER BY CASE WHEN name = 'scan' THEN 0 ELSE 1 END, is_exported DESC, file, line_start, id LIMIT 50")
def find_symbol_kind(g):
    return search.find_symbols(g, "scan", "class")


@query(f"SELECT {_SHOWN} FROM placed WHERE {_fold('file')} LIKE '/srv/code/loomgraph/%' ORDER BY CASE WHEN name = '' THEN 0 ELSE 1 END, is_exported DESC, file, line_start, id LIMIT 50")
def find_symbol_scope(g):
    return search.find_symbols(g, "", scope="/srv/code/loomgraph/")


@query(f"SELECT {_SHOWN} FROM placed WHERE {_has('name', 'get')} ORDER BY CASE WHEN name = 'get' THEN 0 ELSE 1 END, is_exported DESC, file, line_start, id LIMIT 50")
def find_symbol_exact_first(g):
    return search.find_symbols(g, "get")


@query(f"SELECT {_SHOWN} FROM placed WHERE {_has('docstring', 'lock')} ORDER BY is_exported DESC, file, line_start, id LIMIT 20")
def search_docstring(g):
    return search.search_docstrings(g, "lock", limit=20)


@query(f"SELECT {_SHOWN} FROM placed WHERE {_has('docstring', 'order')} AND kind = 'method' AND {_fold('file')} LIKE '/srv/code/%' ORDER BY is_exported DESC, file, line_start, id LIMIT 50")
def search_docstring_kind_scope(g):
    return search.search_docstrings(g, "order", "method", "/srv/code/")


@query(f"SELECT id, name, kind, line_start, line_end, signature, docstring FROM placed WHERE is_exported = 1 AND file = {_PATH}")
def get_exports(g):
    return search.exports_of(g, _largest(g))


@query(f"SELECT i.id, source_path, imported_name, local_name, is_default, is_namespace, line FROM g_imports i JOIN g_files f ON f.id = i.file_id WHERE f.path = {_PATH}")
def get_imports(g):
    return search.imports_of(g, _largest(g))


@query(f"SELECT source_path, string_agg(imported_name, ', ' ORDER BY imported_name) AS names, count(*) AS n FROM g_imports i JOIN g_files f ON f.id = i.file_id WHERE f.path = {_PATH} GROUP BY 1")
def imports_by_source(g):
    return search.imports_by_source(g, _largest(g))


@query(f"SELECT id, name, kind, file, line_start, signature, is_exported FROM placed WHERE kind = 'interface' AND ({_has('name', 'walk')} OR {_has('file', 'walk')}) ORDER BY is_exported DESC, file, line_start, id LIMIT 50")
def find_by_kind(g):
    return search.find_by_kind(g, "interface", "walk")


@query(f"SELECT id, name, kind, file, line_start, signature FROM placed WHERE is_exported = 1 AND {_has('file', 'graph')} ORDER BY file, line_start, id LIMIT 100")
def find_exports(g):
    return search.find_exports(g, "graph")


_HANDLERS = "SELECT name, kind, file, line_start, signature, id FROM placed WHERE regexp_matches(name, '(?i)handler|endpoint|route|controller') AND kind IN ('function', 'method', 'class') ORDER BY file, line_start, id LIMIT 50"
_VERBS = "SELECT name, kind, file, line_start, signature, id FROM placed WHERE id IN (SELECT from_symbol_id FROM g_refs WHERE to_symbol_bare_name IN ('get', 'post', 'put', 'delete', 'patch') AND kind = 'call') ORDER BY file, line_start, id LIMIT 50"


@query(_HANDLERS)
def endpoints_by_name(g):
    return search.endpoints_by_name(g)


@query(_VERBS)
def endpoints_by_http_call(g):
    return search.endpoints_by_call(g)


@query(f", both_lists AS (SELECT *, 0 AS rank FROM ({_HANDLERS}) UNION ALL SELECT *, 1 FROM ({_VERBS})) SELECT file, line_start, name, kind, signature, rank FROM both_lists QUALIFY row_number() OVER (PARTITION BY file, line_start, name ORDER BY rank, id) = 1")
def endpoints_union_dedup(g):
    return search.endpoints(g)


@query(f"SELECT f.path AS file, source_path, imported_name, line, i.id FROM g_imports i JOIN g_files f ON f.id = i.file_id WHERE {_has('f.path', 'core')} ORDER BY file, line, i.id LIMIT 100")
def dependency_of(g):
    return search.dependency_of(g, "core")


@query(f""", mf AS (SELECT id, path FROM g_files WHERE {_has('path', 'router')} ORDER BY path, id LIMIT 10)
 SELECT path AS file, coalesce((SELECT string_agg(kind || ' ' || name, '; ' ORDER BY line_start, id) FROM g_symbols s WHERE s.file_id = mf.id AND is_exported = 1), '') AS exported,
  coalesce((SELECT string_agg(kind || ' ' || name, '; ' ORDER BY line_start, id) FROM g_symbols s WHERE s.file_id = mf.id AND is_exported <> 1), '') AS other,
  (SELECT count(*) FROM g_symbols s WHERE s.file_id = mf.id) AS n_symbols,
  coalesce((SELECT string_agg(source_path, '; ' ORDER BY source_path) FROM (SELECT DISTINCT source_path FROM g_imports i WHERE i.file_id = mf.id)), '') AS sources FROM mf""")
def module_summary(g):
    return search.module_summary(g, "router")


@query("SELECT name, kind, file, line_start, id FROM placed WHERE name IN ('main', 'Main', 'run', 'start', 'init', 'bootstrap', 'setup') AND kind IN ('function', 'method') ORDER BY file, line_start, id LIMIT 20")
def entry_functions(g):
    return search.entry_functions(g)


@query("SELECT path, id FROM g_files WHERE regexp_matches(path, '(?i)/(index|main|app|server)\\.') ORDER BY path, id LIMIT 20")
def entry_files(g):
    return search.entry_files(g)


@query("SELECT f.path, f.id, count(s.id) AS n_symbols FROM g_files f LEFT JOIN g_symbols s ON s.file_id = f.id GROUP BY 1, 2 ORDER BY n_symbols DESC, path, f.id LIMIT 20")
def largest_files(g):
    return search.largest_files(g)


@query(""", w AS (SELECT id AS file_id, coalesce(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda c: c <> '')[3], '') AS project FROM g_files),
 ns AS (SELECT project, count(*) AS n FROM g_symbols JOIN w USING (file_id) GROUP BY 1), nr AS (SELECT project, count(*) AS n FROM g_refs r JOIN g_symbols s ON s.id = r.from_symbol_id JOIN w USING (file_id) GROUP BY 1), ni AS (SELECT project, count(*) AS n FROM g_imports JOIN w USING (file_id) GROUP BY 1)
 SELECT project, count(*) AS n_files, coalesce(any_value(ns.n), 0) AS n_symbols, coalesce(any_value(nr.n), 0) AS n_references, coalesce(any_value(ni.n), 0) AS n_imports FROM w LEFT JOIN ns USING (project) LEFT JOIN nr USING (project) LEFT JOIN ni USING (project) GROUP BY 1""")
def list_projects(g):
    return search.projects(g)


# Closures ------------------------------------------------------------------

_CALLS = ", calls AS MATERIALIZED (SELECT r.id AS ref_id, r.to_symbol_name AS to_symbol, r.to_symbol_bare_name AS to_bare, r.kind AS ref_kind, r.line AS ref_line, r.col AS ref_col, p.name AS from_symbol, p.kind AS from_kind, p.file AS from_file, p.line_start AS from_line FROM g_refs r JOIN placed p ON p.id = r.from_symbol_id)"


# Every reference under each name it meets: its full and bare name, and in lower case what comes before each dot.
_KEYED = f"""{_CALLS}, dotted AS MATERIALIZED (SELECT *, string_split({_fold('to_symbol')}, '.') AS parts FROM calls WHERE contains(to_symbol, '.')),
 keyed AS MATERIALIZED (SELECT *, 'e:' || unnest(list_distinct(list_filter([to_symbol, to_bare], lambda x: x IS NOT NULL))) AS key, CAST(NULL AS VARCHAR) AS but FROM calls
  UNION ALL SELECT * EXCLUDE (parts), 'p:' || unnest(list_distinct(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '.')))) AS key, to_bare AS but FROM dotted)"""


def _levels(roots: str, depth: int) -> str:
    """SQL for ``chain``, with one row per path, level by level from the roots."""
    out, asked = f"{_KEYED}, l0 AS MATERIALIZED (SELECT root, root AS from_symbol FROM ({roots}))", "l0"
    for d in range(1, depth + 1):
        wanted = f"SELECT root, from_symbol AS asked, unnest(['e:' || from_symbol, 'p:' || {_fold('from_symbol')}]) AS want FROM {asked}"
        out += f", l{d} AS MATERIALIZED (SELECT w.root, k.*, {d} AS depth FROM ({wanted}) w JOIN keyed k ON k.key = w.want WHERE k.but IS NULL OR k.but <> w.asked)"
        asked = f"l{d}"
    return out + ", chain AS (" + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(1, depth + 1)) + ")"


def _chain(base: str, depth: int) -> str:
    return _levels(f"SELECT '{base}' AS root", depth)


_REF = "ref_id, to_symbol, ref_kind, ref_line, ref_col, from_symbol, from_kind, from_file, from_line, depth"
_REF_ORDER = "depth, from_file, ref_line, ref_col, ref_id"


@query(f"{_chain('get', 1)} SELECT {_REF} FROM chain ORDER BY {_REF_ORDER} LIMIT 200")
def refs_depth1(g):
    return closure.references_to(g, "get", 1)


@query(f"{_chain('Buffer', 2)} SELECT {_REF} FROM chain ORDER BY {_REF_ORDER} LIMIT 200")
def refs_depth2(g):
    return closure.references_to(g, "Buffer", 2)


@query(f"{_chain('store', 3)} SELECT from_symbol, min(depth) AS first_depth, count(*) AS n_paths FROM chain GROUP BY 1")
def refs_depth3_agg(g):
    return closure.references_to(g, "store", 3, limit=None).groupBy("from_symbol").agg(F.min("depth").alias("first_depth"), F.sum("paths").alias("n_paths"))


@query(f"{_chain('log', 3)} SELECT depth, count(*) AS n_paths, count(DISTINCT ref_id) AS n_references FROM chain GROUP BY 1")
def refs_by_depth_counts(g):
    return closure.references_to(g, "log", 3, limit=None).groupBy("depth").agg(F.sum("paths").alias("n_paths"), F.countDistinct("ref_id").alias("n_references"))


@query(f"{_chain('BaseNode', 2)} SELECT {_REF} FROM chain ORDER BY {_REF_ORDER} LIMIT 200")
def dependents_of(g):
    return closure.references_to(g, "BaseNode", 2)


@query(f"{_chain('map', 2)} SELECT depth, from_symbol, from_file, arg_min(ref_line, (ref_line, ref_col, ref_id)) AS ref_line FROM chain GROUP BY 1, 2, 3")
def callers_dedup_by_depth(g):
    rows = closure.references_to(g, "map", 2, limit=None)
    return closure.first_per_depth(rows, ["from_symbol", "from_file"], ["ref_line", "ref_col", "ref_id"]).select("depth", "from_symbol", "from_file", "ref_line")


_ROOTS = "SELECT DISTINCT name AS root FROM g_symbols WHERE kind = 'interface'"


@query(f"{_levels(_ROOTS, 2)} SELECT root, depth, count(*) AS n_paths FROM chain GROUP BY 1, 2")
def refs_multi_source(g):
    roots = g.raw_symbols.where("kind = 'interface'").select(F.col("name").alias("root")).distinct()
    return closure.path_counts(g, roots, 2)


_CALLER = "(SELECT p.name FROM g_refs r JOIN g_symbols p ON p.id = r.from_symbol_id WHERE r.kind IN ('call', 'instantiation') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _busiest(g: Graph) -> str:
    """The name under which most calls stand."""
    calls = g.references.where(F.col("kind").isin(*closure.CALLING)).join(g.symbols.select(F.col("id").alias("from_symbol_id"), "name"), "from_symbol_id")
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").first()[0]


_CALLEES = f""", cl AS MATERIALIZED (SELECT r.id AS ref_id, s.name AS caller, r.to_symbol_name AS callee, r.to_symbol_bare_name AS callee_bare, r.kind AS ref_kind, r.line AS ref_line FROM g_refs r JOIN g_symbols s ON s.id = r.from_symbol_id WHERE r.kind IN ('call', 'instantiation')),
 c1 AS MATERIALIZED (SELECT cl.*, 1 AS depth FROM cl WHERE caller = {_CALLER}), chain AS (SELECT * FROM c1 UNION ALL SELECT c.*, 2 FROM (SELECT unnest(list_distinct(list_filter([callee, callee_bare], lambda x: x IS NOT NULL))) AS want FROM c1) w JOIN cl c ON c.caller = w.want)"""


@query(f"{_CALLEES} SELECT ref_id, caller, callee, callee_bare, ref_kind, ref_line, depth FROM chain ORDER BY depth, ref_line, callee, ref_id LIMIT 100")
def callees_depth2(g):
    return closure.callee_closure(g, _busiest(g), 2)


@query(f"{_CALLEES} SELECT depth, callee, arg_min(ref_id, (ref_line, ref_id)) AS ref_id FROM chain GROUP BY 1, 2")
def callees_dedup_by_depth(g):
    rows = closure.callee_closure(g, _busiest(g), 2, limit=None)
    return closure.first_per_depth(rows, ["callee"], ["ref_line", "ref_id"]).select("depth", "callee", "ref_id")


@query(f""", im AS MATERIALIZED (SELECT i.id AS import_id, f.path AS file, i.source_path AS source FROM g_imports i JOIN g_files f ON f.id = i.file_id), d1 AS MATERIALIZED (SELECT im.*, 1 AS depth FROM im WHERE file = {_PATH}),
 chain AS (SELECT * FROM d1 UNION ALL SELECT i.*, 2 FROM d1 JOIN im i ON contains({_fold('i.file')}, {_fold('d1.source')}))
 SELECT import_id, file, source, depth FROM chain ORDER BY depth, file, source, import_id LIMIT 100""")
def dependency_tree(g):
    return closure.dependency_closure(g, _largest(g), 2)


# Impact and diffs ------------------------------------------------------------


@query(f"SELECT id, name, kind, file, line_start, line_end, is_exported FROM placed WHERE file = {_PATH} AND line_start <= 400 AND line_end >= 100")
def symbols_in_range(g):
    ranges = g.files.sparkSession.createDataFrame([(_largest(g), 100, 400)], "file string, first int, last int")
    return impact.symbols_in_ranges(g, ranges)


_HIT = f"SELECT DISTINCT id, name, kind, file, line_start, line_end, is_exported FROM placed WHERE file = {_PATH} AND line_start <= 400 AND line_end >= 100"
_IMPACT = f"{_levels(f'SELECT DISTINCT name AS root FROM ({_HIT})', 2)}, hit AS ({_HIT})"


@query(f"{_IMPACT} SELECT h.*, count(*) FILTER (c.depth = 1) AS direct, count(c.depth) AS total, count(DISTINCT c.from_file) AS n_files FROM hit h LEFT JOIN chain c ON c.root = h.name GROUP BY ALL")
def change_impact_counts(g):
    return impact.change_impact(g, _largest(g), 100, 400)


@query(f"{_IMPACT} SELECT h.id, c.depth, c.from_symbol, c.from_file, count(*) AS paths FROM hit h JOIN chain c ON c.root = h.name GROUP BY ALL")
def change_impact_dependents(g):
    ranges = g.files.sparkSession.createDataFrame([(_largest(g), 100, 400)], "file string, first int, last int")
    return impact.dependents(g, impact.symbols_in_ranges(g, ranges), 2, drop_self=False)


def watched_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """(diff_id, diff_text): one diff per file of the watch log that the index knows, made of its symbols.

    Its last event tells whether it is added, deleted or modified. Each symbol gives a hunk
    at its first line: one line of context, one removed, one added.
    """
    g = Graph.read(spark, folder)
    last = ingest.latest_events(load(spark, folder, "watch_log")).select(F.col("path").alias("file"), "change_kind")
    symbols = g.symbols_by_file("name", "line_start").join(g.paths.join(last, "file"), "file_id")
    rows = symbols.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("line_start", "id", "name"))).alias("_h"), F.first("change_kind").alias("change_kind"))

    def hunk(x):
        return F.concat(F.lit("@@ -"), x["line_start"], F.lit(",2 +"), x["line_start"], F.lit(",2 @@ "), x["name"], F.lit("\n context\n-old "), x["name"], F.lit("\n+new "), x["name"])

    rel = F.regexp_replace("path", "^/", "")
    old = F.when(F.col("change_kind") == "add", "/dev/null").otherwise(F.concat(F.lit("a/"), rel))
    new = F.when(F.col("change_kind") == "unlink", "/dev/null").otherwise(F.concat(F.lit("b/"), rel))
    text = F.concat_ws("\n", F.concat(F.lit("diff --git a/"), rel, F.lit(" b/"), rel), F.concat(F.lit("--- "), old), F.concat(F.lit("+++ "), new), F.array_join(F.transform("_h", hunk), "\n"))
    return rows.select(F.col("path").alias("diff_id"), text.alias("diff_text"))


_LAST = """last_event AS (SELECT path, arg_max(change_kind, (happened_at, event_id)) AS change_kind FROM (SELECT DISTINCT * FROM watch_log) GROUP BY path),
 touched AS (SELECT p.*, l.change_kind FROM placed p JOIN last_event l ON l.path = p.file),
 sections AS (SELECT file AS diff_id, CAST(1 AS BIGINT) AS section, CASE any_value(change_kind) WHEN 'add' THEN '/dev/null' ELSE regexp_replace(file, '^/', '') END AS old_file, CASE any_value(change_kind) WHEN 'unlink' THEN '/dev/null' ELSE regexp_replace(file, '^/', '') END AS new_file,
  CASE any_value(change_kind) WHEN 'add' THEN 'added' WHEN 'unlink' THEN 'deleted' ELSE 'modified' END AS status, list(line_start + 1 ORDER BY line_start) AS added, list(line_start + 1 ORDER BY line_start) AS removed, min(line_start) + 1 AS line_min, max(line_start) + 1 AS line_max FROM touched GROUP BY file)"""


@query(f", {_LAST} SELECT * FROM sections", graph=False)
def diff_files(spark, folder):
    return diffs.diff_files(diffs.diff_lines(watched_diffs(spark, folder)))


@query(f", {_LAST} SELECT file AS diff_id, o.op, count(*) AS n, CAST(sum(CASE o.op WHEN '+' THEN NULL ELSE line_start + o.k END) AS BIGINT) AS old_sum, CAST(sum(CASE o.op WHEN '-' THEN NULL ELSE line_start + o.k END) AS BIGINT) AS new_sum FROM touched CROSS JOIN (VALUES (' ', 0), ('-', 1), ('+', 1)) AS o(op, k) GROUP BY 1, 2", graph=False)
def diff_lines(spark, folder):
    lines = diffs.diff_lines(watched_diffs(spark, folder)).where("op <> 'h'")
    return lines.groupBy("diff_id", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("old_line").alias("old_sum"), F.sum("new_line").alias("new_sum"))


# Of a key path "a/b" every indexed path that is it or ends in it counts, the first by order.
_AFFECTED = f""", {_LAST}, tails AS (SELECT path, unnest(list_distinct(list_append(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/')), path))) AS tail FROM g_files),
 located AS (SELECT s.*, (SELECT min(t.path) FROM tails t WHERE t.tail = CASE s.status WHEN 'deleted' THEN s.old_file ELSE s.new_file END) AS file FROM sections s),
 affected AS (
  SELECT a.diff_id, a.section, CASE a.status WHEN 'added' THEN 'added' ELSE 'removed' END AS change, p.id, p.name, p.kind, p.file, p.is_exported FROM located a JOIN placed p ON p.file = a.file WHERE a.status <> 'modified'
  UNION ALL SELECT a.diff_id, a.section, 'modified', p.id, p.name, p.kind, p.file, p.is_exported FROM located a JOIN placed p ON p.file = a.file WHERE a.status = 'modified' AND ((p.line_start <= a.line_max AND p.line_end >= a.line_min) OR len(list_filter(a.added || a.removed, lambda x: x BETWEEN p.line_start AND p.line_end)) > 0))"""


@query(f"{_AFFECTED} SELECT * FROM affected", graph=False)
def diff_affected_symbols(spark, folder):
    sections = diffs.diff_files(diffs.diff_lines(watched_diffs(spark, folder)))
    return diffs.affected_symbols(Graph.read(spark, folder), sections)


def _diff_impact(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.diff_impact(Graph.read(spark, folder), diff_affected_symbols(spark, folder), 1, many=True)


_DIFF_IMPACT = f"""{_AFFECTED} {_levels('SELECT DISTINCT name AS root FROM affected', 1)},
 counted AS (SELECT a.id, count(r.ref_id) AS total, count(DISTINCT r.from_file) AS n_files FROM (SELECT DISTINCT id, name, file FROM affected) a LEFT JOIN chain r ON r.root = a.name AND NOT (r.from_file = a.file AND r.from_symbol = a.name) GROUP BY 1),
 judged AS (SELECT a.*, c.total AS direct, c.total, c.n_files, CASE WHEN a.change = 'removed' AND c.total > 0 THEN 'breaking' WHEN c.total > 5 THEN 'high' ELSE 'none' END AS risk FROM affected a JOIN counted c USING (id))"""


@query(f"{_DIFF_IMPACT} SELECT * FROM judged", graph=False)
def semantic_diff_impact(spark, folder):
    return _diff_impact(spark, folder)


@query(f"{_DIFF_IMPACT} SELECT change, risk, count(*) AS n_symbols, CAST(sum(total) AS BIGINT) AS n_dependents FROM judged GROUP BY 1, 2", graph=False)
def semantic_diff_risk(spark, folder):
    return _diff_impact(spark, folder).groupBy("change", "risk").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("total").alias("n_dependents"))


# Architecture ------------------------------------------------------------------

_WALK = """, rel AS (SELECT DISTINCT f.path AS file, i.source_path AS source FROM g_imports i JOIN g_files f ON f.id = i.file_id WHERE starts_with(i.source_path, '.')),
 walk AS (SELECT file, source, string_split(CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END || '/' || source, '/') AS parts, CAST([] AS VARCHAR[]) AS kept, 1 AS pos FROM rel
  UNION ALL SELECT file, source, parts, CASE WHEN parts[pos] = '..' THEN kept[1:greatest(len(kept) - 1, 0)] WHEN parts[pos] = '.' THEN kept ELSE list_append(kept, parts[pos]) END, pos + 1 FROM walk WHERE pos <= len(parts)),
 based AS (SELECT file, source, array_to_string(kept, '/') AS base FROM walk WHERE pos = len(parts) + 1)"""
_RELATIVE = f"""{_WALK}, tried(rank, suffix) AS (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '.go'), (7, '.rs'), (8, '.java'), (9, '/index.ts'), (10, '/index.js'), (11, '/index.tsx')),
 found AS (SELECT b.file, b.source, arg_min(f.path, t.rank) AS target FROM based b CROSS JOIN tried t JOIN g_files f ON f.path = b.base || t.suffix GROUP BY 1, 2)"""
_SUFFIXED = """, named AS (SELECT DISTINCT f.path AS file, i.source_path AS source FROM g_imports i JOIN g_files f ON f.id = i.file_id WHERE NOT starts_with(i.source_path, '.')),
 sources AS (SELECT DISTINCT source FROM named), ended AS (SELECT s.source, min(f.path) AS target FROM sources s JOIN g_files f ON ends_with(f.path, '/' || s.source) OR ends_with(f.path, '/' || s.source || '.ts') OR ends_with(f.path, '/' || s.source || '.js') GROUP BY 1),
 by_name AS (SELECT n.file, n.source, e.target FROM named n JOIN ended e USING (source))"""
_EDGES = f"{_RELATIVE}{_SUFFIXED}, edges AS (SELECT DISTINCT file AS source_file, target AS target_file FROM (SELECT * FROM found UNION ALL SELECT * FROM by_name))"


@query(f"{_WALK} SELECT file, source, base FROM based")
def normalize_paths(g):
    rows = architecture.import_sources(g).where(F.col("source").startswith("."))
    return rows.select("file", "source", normalise(F.concat(architecture.directory(F.col("file")), F.lit("/"), F.col("source"))).alias("base"))


@query(f"{_RELATIVE} SELECT * FROM found")
def resolve_relative_imports(g):
    return architecture.resolve(g).where(F.col("source").startswith("."))


@query(f"{_SUFFIXED} SELECT * FROM by_name")
def resolve_suffix_imports(g):
    return architecture.resolve(g).where(~F.col("source").startswith("."))


@query(f"{_EDGES} SELECT * FROM edges")
def module_edges(g):
    return architecture.module_edges(g)


@query(f"{_EDGES} SELECT DISTINCT path FROM g_files WHERE path NOT IN (SELECT source_file FROM edges)")
def modules_without_deps(g):
    return architecture.modules_without_edges(g)


_DIR = "CASE WHEN array_to_string(string_split({0}, '/')[1:least(5, len(string_split({0}, '/')) - 1)], '/') = '' THEN 'root' ELSE array_to_string(string_split({0}, '/')[1:least(5, len(string_split({0}, '/')) - 1)], '/') END"


@query(f"SELECT {_DIR.format('path')} AS dir, count(*) AS n_files FROM g_files GROUP BY 1")
def directory_groups(g):
    return architecture.directory_groups(g, depth=5)


@query(f"{_EDGES}, d AS (SELECT {_DIR.format('source_file')} AS source_dir, {_DIR.format('target_file')} AS target_dir FROM edges) SELECT source_dir, target_dir, count(*) AS n_edges FROM d WHERE source_dir <> target_dir GROUP BY 1, 2")
def directory_edges(g):
    return architecture.directory_edges(g, depth=5)


@query("SELECT DISTINCT path, regexp_replace(path, '[^A-Za-z0-9_]', '_', 'g') AS node FROM g_files")
def mermaid_ids(g):
    return g.files.select("path", render.mermaid_id(F.col("path")).alias("node")).distinct()


# By name: in the same file, then what an import of that name leads to, then the exported or any symbol with the least id.
_DEFINED = f"""{_RELATIVE}{_SUFFIXED}, leads AS (SELECT * FROM found UNION ALL SELECT * FROM by_name),
 led AS (SELECT a.id AS file_id, l.source, b.id AS def_file FROM leads l JOIN g_files a ON a.path = l.file JOIN g_files b ON b.path = l.target),
 bound AS (SELECT DISTINCT i.file_id, l.def_file, coalesce(nullif(i.local_name, ''), i.imported_name) AS name, i.imported_name FROM g_imports i JOIN led l ON l.file_id = i.file_id AND l.source = i.source_path),
 asked AS (SELECT file_id, def_file, name, imported_name AS want, 0 AS rank FROM bound UNION ALL SELECT file_id, def_file, name, name, 1 FROM bound WHERE name <> imported_name),
 imported AS (SELECT a.file_id, a.name, arg_min(s.id, (a.rank, 1 - s.is_exported, s.id)) AS id FROM asked a JOIN g_symbols s ON s.file_id = a.def_file AND s.name = a.want GROUP BY 1, 2),
 local AS (SELECT name, file_id, min(id) AS id FROM g_symbols GROUP BY 1, 2), anywhere AS (SELECT name, arg_min(id, (1 - is_exported, id)) AS id FROM g_symbols GROUP BY 1),
 wanted AS (SELECT DISTINCT r.id AS ref_id, regexp_extract(r.to_symbol_name, '[^.]*$') AS name, o.file_id FROM g_refs r JOIN g_symbols o ON o.id = r.from_symbol_id)"""


@query(f"{_DEFINED} SELECT w.ref_id, coalesce(l.id, m.id, a.id) AS definition_id FROM wanted w LEFT JOIN local l ON l.name = w.name AND l.file_id = w.file_id LEFT JOIN imported m ON m.name = w.name AND m.file_id = w.file_id LEFT JOIN anywhere a ON a.name = w.name")
def goto_definition_by_name(g):
    return search.definitions(g)


@query("SELECT to_symbol_bare_name AS target, count(DISTINCT (p.id, p.file)) AS n_implementations, count(DISTINCT p.file) AS n_files FROM g_refs r JOIN placed p ON p.id = r.from_symbol_id WHERE r.kind IN ('extends', 'implements') AND to_symbol_bare_name IS NOT NULL GROUP BY 1")
def find_implementations_by_name(g):
    return search.implementations(g)


# Upkeep of the index -------------------------------------------------------------


@query(""", f AS (SELECT path, arg_min(hash, (indexed_at, hash)) AS first_hash, arg_max(hash, (indexed_at, hash)) AS last_hash, count(DISTINCT indexed_at) AS n FROM files GROUP BY path), known AS (SELECT path, first_hash FROM f WHERE n > 1 OR starts_with(last_hash, '0') OR first_hash < 'c')
 SELECT f.path, f.last_hash AS hash, CASE WHEN k.path IS NULL THEN 'new' WHEN k.first_hash = f.last_hash THEN 'unchanged' ELSE 'changed' END AS state FROM f LEFT JOIN known k USING (path)""", graph=False)
def hash_skip_split(spark, folder):
    """The files as last indexed, against the index as it first was, which lacked those whose hash begins with a letter from c on."""
    files = load(spark, folder, "files")
    per = files.groupBy("path").agg(F.min_by("hash", F.struct("indexed_at", "hash")).alias("first_hash"), F.max_by("hash", F.struct("indexed_at", "hash")).alias("hash"), F.countDistinct("indexed_at").alias("n"))
    known = per.where("n > 1 OR startswith(hash, '0') OR first_hash < 'c'").select("path", F.col("first_hash").alias("hash"))
    return maintenance.split_by_hash(per.select("path", "hash"), known)


def _tables(g: Graph) -> dict[str, DataFrame]:
    return {"files": g.files, "symbols": g.symbols, "references": g.references, "imports": g.imports}


_GONE = f""", {_LAST}, gone AS (SELECT f.id FROM g_files f JOIN last_event l ON l.path = f.path WHERE l.change_kind = 'unlink')"""


@query(f"""{_GONE} SELECT 'files' AS relation, count(*) AS n FROM g_files WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'symbols', count(*) FROM g_symbols WHERE file_id NOT IN (SELECT id FROM gone)
 UNION ALL SELECT 'references', count(*) FROM g_refs WHERE from_symbol_id NOT IN (SELECT id FROM g_symbols WHERE file_id IN (SELECT id FROM gone)) UNION ALL SELECT 'imports', count(*) FROM g_imports WHERE file_id NOT IN (SELECT id FROM gone)""", graph=False)
def remove_cascade(spark, folder):
    """What is left of each relation once the files that the watch log last saw unlinked are removed."""
    g = Graph.read(spark, folder)
    last = ingest.latest_events(load(spark, folder, "watch_log")).where("change_kind = 'unlink'").select("path")
    gone = g.files.join(last, "path", "left_semi").select(F.col("id").alias("file_id"))
    return maintenance.table_counts(maintenance.without_files(_tables(g), gone))


@query(f""", {_LAST}, again AS (SELECT f.id FROM g_files f JOIN last_event l ON l.path = f.path WHERE l.change_kind = 'change')
 SELECT kind, count(*) AS n, count(*) FILTER (file_id IN (SELECT id FROM again)) AS n_replaced, CAST(sum(line_start + CASE WHEN file_id IN (SELECT id FROM again) THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM g_symbols GROUP BY 1""", graph=False)
def replace_changed(spark, folder):
    """Symbols per kind after the changed files of the watch log were parsed anew, each symbol a line further down."""
    g = Graph.read(spark, folder)
    last = ingest.latest_events(load(spark, folder, "watch_log")).where("change_kind = 'change'").select("path")
    again = g.files.join(last, "path", "left_semi")
    ids = again.select(F.col("id").alias("file_id"))
    symbols = g.symbols.join(ids, "file_id", "left_semi").withColumn("line_start", (F.col("line_start") + 1).cast("int"))
    refs = g.references.join(symbols.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi")
    tables = maintenance.replace_files(_tables(g), {"files": again, "symbols": symbols, "references": refs, "imports": g.imports.join(ids, "file_id", "left_semi")})
    marked = tables["symbols"].join(ids.withColumn("_r", F.lit(1)), "file_id", "left")
    return marked.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("n_replaced"), F.sum("line_start").alias("lines"))


@query(f"""{_GONE}, left_files AS (SELECT * FROM g_files WHERE id NOT IN (SELECT id FROM gone)), left_symbols AS (SELECT * FROM g_symbols WHERE file_id IN (SELECT id FROM left_files))
 SELECT 'files' AS relation, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM left_files UNION ALL SELECT 'symbols', count(*), CAST(sum(id) AS BIGINT) FROM left_symbols
 UNION ALL SELECT 'references', count(*), CAST(sum(id) AS BIGINT) FROM g_refs WHERE from_symbol_id IN (SELECT id FROM left_symbols) UNION ALL SELECT 'imports', count(*), CAST(sum(id) AS BIGINT) FROM g_imports WHERE file_id IN (SELECT id FROM left_files)""", graph=False)
def index_roundtrip(spark, folder):
    """The index stored, the files that the watch log saw changed stored again, those it last saw unlinked removed, and what is then live read back."""
    g = Graph.read(spark, folder)
    owner = g.symbols_with("file_id").select(F.col("id").alias("from_symbol_id"), "file_id")
    files = latest(load(spark, folder, "files"))
    tables = {"files": files, "symbols": g.symbols, "references": g.references.join(owner, "from_symbol_id"), "imports": g.imports}
    index = Index(spark, f"{shared_folder(spark)}/index-{spark.sql('SELECT uuid()').first()[0]}")
    index.put(tables)
    last = ingest.latest_events(load(spark, folder, "watch_log")).select("path", "change_kind")
    touched = g.files.join(last, "path").select(F.col("id").alias("file_id"), "change_kind")
    again = touched.where("change_kind = 'change'").select("file_id")
    parts = {t: tables[t].join(again, "file_id", "left_semi") for t in ("symbols", "references", "imports")}
    index.put({"files": files.join(again.withColumnRenamed("file_id", "id"), "id", "left_semi"), **parts})
    index.remove(touched.where("change_kind = 'unlink'"))
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).select(F.lit(r).alias("relation"), "n", "ids") for r, t in sorted(index.tables().items())])


@query("SELECT id, name, kind, file_id, line_start FROM g_symbols QUALIFY row_number() OVER (PARTITION BY name, kind, file_id, line_start ORDER BY id) > 1")
def unique_violation_rejects(g):
    return maintenance.unique_symbols(g.symbols).where("kept = 0").select("id", "name", "kind", "file_id", "line_start")


@query(", o AS (SELECT id, file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_start, col_start, id) - 1 AS ordinal FROM g_symbols) SELECT o.id, o.file_id, o.ordinal, p.ordinal AS parent_ordinal FROM o JOIN g_symbols s ON s.id = o.id LEFT JOIN o p ON p.id = s.parent_symbol_id AND p.file_id = o.file_id")
def parent_remap(g):
    return maintenance.remap_parents(g.symbols)


@query("SELECT id, to_symbol_name, regexp_extract(to_symbol_name, '[^.]*$') AS bare FROM g_refs")
def bare_name(g):
    return g.references.select("id", "to_symbol_name", maintenance.bare_name(F.col("to_symbol_name")).alias("bare"))


@query("SELECT DISTINCT doc_id, sha256(text) AS hash FROM documents", graph=False)
def content_hashes(spark, folder):
    return load(spark, folder, "documents").select("doc_id", maintenance.content_hash(F.col("text")).alias("hash")).distinct()


# Questions -----------------------------------------------------------------------


def _intent_sql() -> str:
    quote = lambda s: s.replace("'", "''")
    target = "coalesce(" + ", ".join(f"nullif(regexp_extract(q, '{quote(p)}', 1), '')" for p in intent.TARGETS) + ")"
    after = f"coalesce(nullif(regexp_extract(q, '{quote(intent.AFTER)}', 1), ''), nullif(regexp_extract(q, '{quote(intent.AFTER)}', 2), ''))"
    cases = " ".join(
        f"WHEN regexp_matches(q, '{quote(words)}')" + (f" AND NOT contains(q, '{without}')" if without else "") + (f" AND {target if needs == 'target' else after} IS NOT NULL" if needs else "") + f" THEN '{name}'" for name, words, without, needs in intent.RULES
    )
    return f"SELECT item_id, CASE {cases} ELSE 'symbol_search' END AS intent, {target} AS target FROM (SELECT DISTINCT item_id, lower(trim(text)) AS q FROM eval_items)"


@query(f", routed AS ({_intent_sql()}) SELECT * FROM routed", graph=False)
def intent_classify(spark, folder):
    """How each question of the evaluation items would be routed, and its target."""
    items = load(spark, folder, "eval_items").select("item_id", "text").distinct()
    return items.select("item_id", intent.classify(F.col("text")).alias("intent"), intent.target(intent.folded(F.col("text"))).alias("target"))


# Extraction from the code in documents ---------------------------------------------

#: Endings under which a text with code is read, by what the first line of some declaration in it looks like.
LOOKS = [
    ("go", ".go", r"(?m)^(func [\w(]|package \w+\s*$|type \w+ (struct|interface)\b)"),
    ("rust", ".rs", r"(?m)^\s*(pub(\([^)]*\))? )?((async|unsafe|const) )*(fn \w+|trait \w+|impl\b.*\{|mod \w+|struct \w+[^;]*\{|use \w+::)"),
    ("python", ".py", r"(?m)^\s*((async )?def \w+\(|class \w+(\([^)]*\))?:|from [\w.]+ import )"),
    ("typescript", ".ts", r"(?m)^\s*(export )?(default )?((async )?function\b|class \w+[^:;]*\{|interface \w+|type \w+ ?=|enum \w+ \{|(const|let|var) [\w$]+ ?[:=])"),
]


def _look(lang: str) -> tuple[str, str]:
    return next((e, p) for name, e, p in LOOKS if name == lang)


def _code_of(spark: SparkSession, folder: str, lang: str) -> dict[str, DataFrame]:
    docs = load(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", "text").distinct()
    ending, look = _look(lang)
    return extract.scan_sources(docs.where(F.col("text").rlike(look)).select(F.concat(F.col("doc_id").cast("string"), F.lit(ending)).alias("file"), F.col("text").alias("content")))


def _extractor(lang: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _code_of(spark, folder, lang)["symbols"].select("file", "ordinal", "name", "kind", "line_start", "line_end", "parent_ordinal", "signature", "is_exported", "docstring")

    QUERIES[f"extract_{lang}"] = run


for _lang, _, _ in LOOKS:
    _extractor(_lang)

_LINES = rf", src AS (SELECT DISTINCT doc_id, text FROM documents WHERE regexp_matches(text, '{_look('go')[1]}')), ln AS (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(10))) AS t FROM src)"


@query(rf"{_LINES} SELECT concat(doc_id, '.go') AS file, regexp_extract(t, '^func (\w+)', 1) AS name, count(*) AS n FROM ln WHERE regexp_matches(t, '^func \w+') GROUP BY 1, 2", graph=False)
def extract_go_functions(spark, folder):
    """The Go functions per text, which SQL can tell by their first line."""
    return _code_of(spark, folder, "go")["symbols"].where("kind = 'function'").groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"))


@query(graph=False)
def extract_go_references(spark, folder):
    return _code_of(spark, folder, "go")["references"]


@query(graph=False)
def extract_docstrings(spark, folder):
    """The comment above each Python function, or its own string."""
    return _code_of(spark, folder, "python")["symbols"].where("docstring IS NOT NULL").select("file", "name", "docstring")


# Streams ---------------------------------------------------------------------------


@query("SELECT change_kind, count(DISTINCT event_id) AS n FROM watch_log GROUP BY 1", graph=False)
def stream_events_once(spark, folder):
    """Events by kind, each counted once however often it was delivered, read as a stream."""
    schema = load(spark, folder, "watch_log").schema.simpleString()[7:-1].replace(":", " ")
    events = ingest.event_stream(spark, f"{folder}/watch_log.parquet", schema)
    written = ingest.run_to_end(events.select("event_id", "change_kind"), "events", "event_id")
    return written.groupBy("change_kind").agg(F.countDistinct("event_id").alias("n"))


@query(f", {_LAST} SELECT path, change_kind FROM last_event WHERE change_kind = 'unlink'", graph=False)
def stream_delete_tombstones(spark, folder):
    """Paths whose last event is their removal, from the stream of events."""
    schema = load(spark, folder, "watch_log").schema.simpleString()[7:-1].replace(":", " ")
    events = ingest.event_stream(spark, f"{folder}/watch_log.parquet", schema)
    written = ingest.run_to_end(events.select("event_id", "file_id", "path", "change_kind", "happened_at"), "tombstones", "event_id")
    return ingest.latest_events(written).where("change_kind = 'unlink'").select("path", "change_kind")


@query(", f AS (SELECT date_trunc('month', happened_at) AS month, change_kind, count(DISTINCT event_id) AS n FROM watch_log GROUP BY 1, 2) SELECT strftime(month, '%Y-%m') AS month, change_kind, n FROM f", graph=False)
def events_by_month(spark, folder):
    events = load(spark, folder, "watch_log").select("event_id", "change_kind", "happened_at").distinct()
    return events.groupBy(F.date_format("happened_at", "yyyy-MM").alias("month"), "change_kind").agg(F.countDistinct("event_id").alias("n"))

