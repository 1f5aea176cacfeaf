"""Queries of the data-preparation operators in the core, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.hierarchy import depths_and_roots, full_hierarchy
from codelode.operators.orphans import find_orphans, index_orphans, orphans_by_month
from codelode.operators.skew import keyed_counts
from codelode.session import cut
from codelode.sources.tables import load

KEY = ["to_symbol_bare_name", "kind"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that hold at least a fiftieth of all references, counted by id."""
    per_key = cut(keyed_counts(load(spark, folder, "references_"), KEY, "id"))
    total = per_key.agg(F.sum("n_rows")).first()[0] or 0
    return per_key.where(F.col("n_rows") * 50 >= total).select(*KEY)


def p1_reference_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per callee name and kind: references, distinct callers, first and last line."""
    return keyed_counts(load(spark, folder, "references_"), KEY, "id", "from_symbol_id", ["line"])


def _index(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [load(spark, folder, t) for t in ("files", "symbols", "references_", "imports")]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return index_orphans(*_index(spark, folder))


def p3_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_by_month(*_index(spark, folder))


def p3_composite_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """References whose (bare name, file) names no symbol of that file; with one of the two unknown, no symbol agrees on the other."""
    _, symbols, refs, _ = _index(spark, folder)
    named = refs.select("id", F.substring_index("to_symbol_name", ".", -1).alias("callee"), "to_file_id")
    return find_orphans(named, "id", symbols, [("callee", "name"), ("to_file_id", "file_id")], "partial")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return depths_and_roots(load(spark, folder, "symbols"))


def p4_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return full_hierarchy(load(spark, folder, "symbols"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reference_summary, p3_found, p3_orphans_by_month, p3_composite_orphans, p4_found, p4_hierarchy)}

_REFS = "(SELECT DISTINCT id, from_symbol_id, to_symbol_name, to_symbol_bare_name, to_file_id, kind, line FROM references_)"
_SEEN = "(SELECT id AS file_id, min(path) AS path, min(indexed_at) AS first_at FROM files GROUP BY id)"
_OWNER = f"(SELECT s.id AS from_symbol_id, f.first_at AS ref_at FROM (SELECT DISTINCT id, file_id FROM symbols) s JOIN {_SEEN} f ON f.file_id = s.file_id)"
_SUFFIXES = "(VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '.go'), (7, '.rs'), (8, '.java'), (9, '/index.ts'), (10, '/index.js'), (11, '/index.tsx')) AS x(rank, suffix)"
# Components are folded one by one in a recursion: a '..' drops the last kept one.
_RESOLVED = f"""
 walk AS (SELECT i.id, f.first_at AS ref_at,
    string_split(CASE WHEN contains(f.path, '/') THEN regexp_replace(f.path, '/[^/]*$', '') ELSE '' END || '/' || i.source_path, '/') AS parts,
    CAST([] AS VARCHAR[]) AS kept, 1 AS pos
    FROM (SELECT DISTINCT id, file_id, source_path FROM imports) i JOIN {_SEEN} f ON f.file_id = i.file_id
    WHERE i.source_path LIKE './%' OR i.source_path LIKE '../%'
  UNION ALL SELECT id, ref_at, parts, CASE WHEN parts[pos] = '..' THEN kept[1:greatest(len(kept) - 1, 0)] WHEN parts[pos] = '.' THEN kept ELSE list_append(kept, parts[pos]) END, pos + 1
    FROM walk WHERE pos <= len(parts)),
 based AS (SELECT id, ref_at, array_to_string(kept, '/') AS base FROM walk WHERE pos = len(parts) + 1),
 paths AS (SELECT path, min(first_at) AS target_at FROM {_SEEN} GROUP BY path),
 hits AS (SELECT b.id, b.ref_at, x.rank, p.target_at FROM based b CROSS JOIN {_SUFFIXES} JOIN paths p ON p.path = b.base || x.suffix),
 resolved AS (SELECT b.id, any_value(b.ref_at) AS ref_at, min_by(h.target_at, h.rank) AS target_at FROM based b LEFT JOIN hits h ON h.id = b.id GROUP BY b.id)"""
_FOUND3 = f"""{_RESOLVED},
 found AS (
  SELECT DISTINCT 'to_symbol_name' AS field, id AS row_id FROM references_ WHERE to_symbol_name IS NOT NULL
     AND to_symbol_name NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL)
     AND regexp_extract(to_symbol_name, '[^.]*$') NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL)
  UNION SELECT 'to_file_id', r.id FROM {_REFS} r LEFT JOIN {_SEEN} f ON f.file_id = r.to_file_id LEFT JOIN {_OWNER} o ON o.from_symbol_id = r.from_symbol_id
     WHERE r.to_file_id IS NOT NULL AND (f.file_id IS NULL OR f.first_at > o.ref_at)
  UNION SELECT 'source_path', id FROM resolved WHERE target_at IS NULL OR target_at > ref_at)"""
_PARENTS = "(SELECT id AS v, min(parent_symbol_id) AS p FROM symbols GROUP BY id)"
_LINKS = f"(SELECT a.v, a.p FROM {_PARENTS} a WHERE a.p IN (SELECT id FROM symbols))"
# Ways up end or come back to a node already met.
_CLIMB = f"""
 links AS (SELECT v, p FROM {_LINKS}),
 climb AS (SELECT v, p AS top, CAST(1 AS BIGINT) AS depth, [v] AS met FROM links
  UNION ALL SELECT c.v, l.p, c.depth + 1, list_append(c.met, c.top) FROM climb c JOIN links l ON l.v = c.top WHERE NOT list_contains(c.met, c.top)),
 tops AS (SELECT v AS id, top AS root_id, depth FROM climb WHERE top NOT IN (SELECT v FROM links)),
 placed AS (SELECT l.v AS id, coalesce(t.root_id, -1) AS root_id, coalesce(t.depth, -1) AS depth FROM links l LEFT JOIN tops t ON t.id = l.v)"""

ORACLE = {
    "p1_found": f"SELECT to_symbol_bare_name, kind FROM {_REFS} r GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(DISTINCT id) FROM references_)",
    "p1_reference_summary": f"SELECT to_symbol_bare_name, kind, count(*) AS n_rows, count(DISTINCT from_symbol_id) AS n_members, min(line) AS min_line, max(line) AS max_line FROM {_REFS} r GROUP BY 1, 2",
    "p3_found": f"WITH RECURSIVE {_FOUND3} SELECT field, row_id FROM found",
    "p3_orphans_by_month": f"""WITH RECURSIVE {_FOUND3},
 dated AS (SELECT 'references_' AS table_name, o.field, w.ref_at FROM found o JOIN {_REFS} r ON r.id = o.row_id LEFT JOIN {_OWNER} w ON w.from_symbol_id = r.from_symbol_id WHERE o.field <> 'source_path'
  UNION ALL SELECT 'imports', o.field, f.first_at FROM found o JOIN (SELECT DISTINCT id, file_id FROM imports) i ON i.id = o.row_id LEFT JOIN {_SEEN} f ON f.file_id = i.file_id WHERE o.field = 'source_path')
 SELECT table_name, field, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_orphans FROM dated GROUP BY 1, 2, 3""",
    "p3_composite_orphans": """WITH r AS (SELECT DISTINCT id, regexp_extract(to_symbol_name, '[^.]*$') AS callee, to_file_id FROM references_), s AS (SELECT DISTINCT name, file_id FROM symbols)
 SELECT id, callee, to_file_id FROM r WHERE (callee IS NOT NULL OR to_file_id IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.name = r.callee AND s.file_id = r.to_file_id)
  AND NOT (r.to_file_id IS NULL AND EXISTS (SELECT 1 FROM s WHERE s.name = r.callee)) AND NOT (r.callee IS NULL AND EXISTS (SELECT 1 FROM s WHERE s.file_id = r.to_file_id))""",
    "p4_found": f"WITH RECURSIVE {_CLIMB} SELECT id, root_id, depth FROM placed",
    # Of a node, all nodes of its tree whose path comes before its own were entered before it, and but for its ancestors left again.
    "p4_hierarchy": f"""WITH RECURSIVE {_CLIMB},
 below AS (SELECT v AS id, top AS root_id, depth, list_reverse(list_append(met, top)) AS path FROM climb WHERE top NOT IN (SELECT v FROM links)),
 own AS (SELECT a AS id, count(*) AS n FROM (SELECT id, unnest(path) AS a FROM below) WHERE a <> id GROUP BY 1),
 arcs AS (SELECT root_id, 2 * count(*) AS total FROM below GROUP BY 1),
 entered AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS k FROM below),
 inner_nodes AS (SELECT e.id, e.root_id, e.depth, e.path, coalesce(o.n, 0) AS n_descendants, a.total - 2 * (k - depth + 1) - (depth - 1) AS tour_in FROM entered e JOIN arcs a USING (root_id) LEFT JOIN own o ON o.id = e.id)
 SELECT id, root_id, depth, path, n_descendants, tour_in, tour_in - 1 - 2 * n_descendants AS tour_out, 'inner' AS status FROM inner_nodes
 UNION ALL SELECT p.v, p.v, 0, [p.v], coalesce(o.n, 0), coalesce(a.total, 0) + 1, 0, 'root' FROM {_PARENTS} p LEFT JOIN own o ON o.id = p.v LEFT JOIN arcs a ON a.root_id = p.v WHERE p.v NOT IN (SELECT v FROM links)
 UNION ALL SELECT l.id, -1, -1, NULL, NULL, NULL, NULL, CASE WHEN EXISTS (SELECT 1 FROM climb c WHERE c.v = l.id AND c.top = l.id) THEN 'on_cycle' ELSE 'below_cycle' END FROM placed l WHERE l.root_id = -1""",
}
