"""Questions in words to named queries, as column expressions and for one question."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators import closure, search
from codelode.sources.graph import Graph

# The rules in the order tried: intent, words that call for it, words that forbid it, whether it needs a target.
RULES = [
    ("find_endpoints", r"\b(endpoint|route|api|handler|controller)\b", None, None),
    ("find_classes", r"\b(class|classes)\b", "depend", None),
    ("find_interfaces", r"\b(interface|interfaces|contract)\b", None, None),
    ("find_functions", r"\b(function|functions|method|methods)\b", "depend", None),
    ("find_exports", r"\b(export|exports|public api)\b", None, None),
    ("dependency_of", r"\b(depend on|depends on|import|imports from|uses)\b", None, "target"),
    ("dependents_of", r"\b(depends on|depend on|who uses|what uses|references|consumers of|callers of)\b", None, "after"),
    ("module_summary", r"\b(what does|describe|summarize|overview|about)\b", None, "target"),
    ("entry_points", r"\b(entry point|main|entrypoint|start)\b", None, None),
    ("largest_files", r"\b(largest|biggest|most complex|most symbols)\b", None, None),
]
# How a target is told: quoted, like a file, or after one of these words.
TARGETS = [r"""["'`]([^"'`]+)["'`]""", r"\b([\w/.-]+\.\w+)\b", r"(?:in|from|of|about|the)\s+(\w+)"]
AFTER = r"""(?:depends? on|who uses|what uses|references|consumers of|callers of)\s+(?:["'`]([^"'`]+)["'`]|([\w./-]+))"""


def folded(question: Column) -> Column:
    return F.lower(F.trim(question))


def target(question: Column) -> Column:
    """What a lower-case question asks about, null if nothing tells."""
    return F.coalesce(*[F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in TARGETS])


def target_after(question: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(question, AFTER, i), F.lit("")) for i in (1, 2)])


def classify(question: Column) -> Column:
    """The intent of a question: that of the first rule that holds, else symbol_search."""
    q = folded(question)
    out = F.lit("symbol_search")
    for name, words, without, needs in reversed(RULES):
        holds = q.rlike(words)
        if without:
            holds = holds & ~q.contains(without)
        if needs:
            holds = holds & (target(q) if needs == "target" else target_after(q)).isNotNull()
        out = F.when(holds, name).otherwise(out)
    return out


def understand(question: str) -> tuple[str, str | None]:
    """(intent, target) of one question, by the same rules."""
    q = question.strip().lower()

    def first(patterns: list[str]) -> str | None:
        for p in patterns:
            m = re.search(p, q)
            if m:
                return next((x for x in m.groups() if x), None)
        return None

    for name, words, without, needs in RULES:
        if re.search(words, q) and not (without and without in q):
            found = first([AFTER] if needs == "after" else TARGETS)
            if found or not needs:
                return name, found
    return "symbol_search", first(TARGETS) or q


def answer(g: Graph, question: str) -> DataFrame:
    """The table that answers one question."""
    intent, about = understand(question)
    about = about or ""
    routes = {
        "find_endpoints": lambda: search.endpoints(g),
        "find_classes": lambda: search.find_by_kind(g, "class", about),
        "find_interfaces": lambda: search.find_by_kind(g, "interface", about),
        "find_functions": lambda: search.find_by_kind(g, "function", about),
        "find_exports": lambda: search.find_exports(g, about),
        "dependency_of": lambda: search.dependency_of(g, about),
        "dependents_of": lambda: closure.references_to(g, about, 2),
        "module_summary": lambda: search.module_summary(g, about),
        "entry_points": lambda: search.entry_points(g),
        "largest_files": lambda: search.largest_files(g),
        "symbol_search": lambda: search.find_symbols(g, about, limit=30),
    }
    return routes[intent]()
