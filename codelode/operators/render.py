"""Short lists as text and mermaid, as the tools answer them.

The tables are the result; these put at most a few hundred collected rows into words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def mermaid_id(c: Column) -> Column:
    """A name as a node id: whatever is no ASCII letter, digit or underscore becomes an underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")


def _id(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", text)


def symbol_list(rows: Iterable) -> str:
    """One line per symbol, with its signature."""
    lines = [f"[{r['kind']}] {r['name']} at {r['file']}:{r['line_start']}" + (f" :: {r['signature']}" if r["signature"] else "") for r in rows]
    return "\n".join(lines) or "Nothing found."


def references_by_depth(name: str, rows: Iterable) -> str:
    """References under a heading per depth."""
    by_depth = defaultdict(list)
    for r in rows:
        by_depth[r["depth"]].append(f"  {r['from_symbol']} ({r['ref_kind']}) at {r['from_file']}:{r['ref_line']}")
    parts = [f"Depth {d}:\n" + "\n".join(by_depth[d]) for d in sorted(by_depth)]
    return f"References to {name}\n" + "\n".join(parts) if parts else f"No references to {name}."


def call_graph(name: str, callers: Iterable, callees: Iterable, mermaid: bool = False) -> str:
    """Callers and callees of one function, as trees by depth or as a mermaid graph; callers point at the function itself at any depth."""
    callers, callees = list(callers), list(callees)
    if mermaid:
        root = _id(name)
        edges = [f"  {_id(r['from_symbol'])} --> {root}" for r in callers] + [f"  {_id(r['caller'])} --> {_id(r['callee'])}" for r in callees]
        return "\n".join(["graph TD", *dict.fromkeys(edges)])
    up = [f"{'  ' * r['depth']}<- {r['from_symbol']} ({r['from_file']})" for r in callers]
    down = [f"{'  ' * r['depth']}-> {r['callee']}" for r in callees]
    return "\n".join([name, "callers:", *(up or ["  none"]), "callees:", *(down or ["  none"])])


def module_diagram(edges: Iterable, groups: Iterable, mermaid: bool = True) -> str:
    """Directories and the imports between them."""
    edges, groups = list(edges), list(groups)
    if not mermaid:
        return "\n".join([f"{g['dir']} ({g['n_files']} files)" for g in groups] + [f"{e['source_dir']} -> {e['target_dir']} ({e['n_edges']})" for e in edges])
    nodes = [f'  {_id(g["dir"])}["{g["dir"]} ({g["n_files"]})"]' for g in groups]
    return "\n".join(["graph LR", *nodes, *[f"  {_id(e['source_dir'])} -->|{e['n_edges']}| {_id(e['target_dir'])}" for e in edges]])


def impact_report(rows: Iterable) -> str:
    """What a change touches, the riskiest first."""
    rows = sorted(rows, key=lambda r: (-r["total"], r["name"], r["id"]))
    lines = [f"{r['name']} ({r['kind']}): {r['direct']} direct, {r['total']} in all, {r['n_files']} files" + (f", {r['risk']}" if "risk" in r.asDict() and r["risk"] != "none" else "") for r in rows]
    return "\n".join(lines) or "No indexed symbols are affected."


def source_context(lines: list[str], line: int, before: int = 1, after: int = 3) -> str:
    """The lines around one, numbered, that one marked."""
    first, last = max(1, line - before), min(len(lines), line + after)
    return "\n".join(f"{'>' if n == line else ' '} {n}: {lines[n - 1]}" for n in range(first, last + 1))
