"""Unified diffs: parsing, affected symbols, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.closure import OWNER
from codelode.operators.impact import dependents, impact_counts, with_direct_counts
from codelode.session import cut
from codelode.sources.graph import Graph

HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
#: More dependents than this make a change one of high impact.
HIGH_IMPACT = 5


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, section, pos, text, hunk, old_line, new_line, op) of the lines of (diff_id, diff_text).

    A section begins at each ``diff --git`` outside or after a hunk. Within a hunk lines
    with + number the new text, with - the old, all others both. One diff is numbered in
    one task, in order of its lines; different diffs are independent. Null and empty
    texts give no sections.
    """
    text = F.regexp_replace(F.col("diff_text"), "\r\n", "\n")
    lines = diffs.select("diff_id", F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    by_diff = Window.partitionBy("diff_id").orderBy("pos")
    lines = lines.withColumn("section", F.sum(F.col("text").startswith("diff --git").cast("int")).over(by_diff)).where("section > 0")
    in_section = Window.partitionBy("diff_id", "section").orderBy("pos")
    lines = lines.withColumn("hunk", F.sum(F.col("text").rlike(HUNK).cast("int")).over(in_section))
    in_hunk = Window.partitionBy("diff_id", "section", "hunk").orderBy("pos")
    header = F.first("text").over(in_hunk)
    body = (F.col("hunk") > 0) & ~F.col("text").rlike(HUNK)
    op = F.when(~body, "h").when(F.col("text").startswith("+") & ~F.col("text").startswith("+++"), "+").when(F.col("text").startswith("-") & ~F.col("text").startswith("---"), "-").otherwise(" ")
    lines = lines.withColumn("op", op).withColumn("_head", header)
    before = in_hunk.rowsBetween(Window.unboundedPreceding, -1)

    def number(group: int, other: str):
        passed = F.coalesce(F.sum(F.when((F.col("op") != "h") & (F.col("op") != other), 1).otherwise(0)).over(before), F.lit(0))
        return F.when(F.col("op").isin("h", other), None).otherwise(F.regexp_extract("_head", HUNK, group).try_cast("int") + passed)

    return lines.withColumn("old_line", number(1, "+")).withColumn("new_line", number(2, "-")).select("diff_id", "section", "pos", "text", "hunk", "old_line", "new_line", "op")


def diff_files(lines: DataFrame) -> DataFrame:
    """Per section: old_file, new_file, status, added and removed line numbers, line_min and line_max (1 where no line changed)."""
    head = F.when(F.col("hunk") == 0, F.col("text"))

    def path(prefix: str):
        return F.max(F.when(head.startswith(prefix), F.regexp_replace(F.regexp_replace(F.substring("text", 5, 1 << 20), r"\t.*$", ""), r"^[ab]/", "")))

    git = F.max(F.when(F.col("text").startswith("diff --git"), F.col("text")))
    out = lines.groupBy("diff_id", "section").agg(
        path("--- ").alias("_old"), path("+++ ").alias("_new"), git.alias("_git"),
        F.coalesce(F.max(head.startswith("rename from").cast("int")), F.lit(0)).alias("_moved"),
        F.max(F.when(head.startswith("rename from "), F.substring("text", 13, 1 << 20))).alias("_from"), F.max(F.when(head.startswith("rename to "), F.substring("text", 11, 1 << 20))).alias("_to"),
        F.array_sort(F.collect_list(F.when(F.col("op") == "+", F.col("new_line")))).alias("added"), F.array_sort(F.collect_list(F.when(F.col("op") == "-", F.col("old_line")))).alias("removed"),
    )
    old = F.coalesce("_old", "_from", F.regexp_extract("_git", r"^diff --git a/(.*) b/.*$", 1))
    new = F.coalesce("_new", "_to", F.regexp_extract("_git", r"^diff --git a/.* b/(.*)$", 1))
    changed = F.concat("added", "removed")
    status = F.when(F.col("_old") == "/dev/null", "added").when(F.col("_new") == "/dev/null", "deleted").when(F.col("_moved") == 1, "renamed").otherwise("modified")
    return out.select("diff_id", "section", old.alias("old_file"), new.alias("new_file"), status.alias("status"), "added", "removed", F.coalesce(F.array_min(changed), F.lit(1)).alias("line_min"), F.coalesce(F.array_max(changed), F.lit(1)).alias("line_max"))


def _located(g: Graph, sections: DataFrame, column: str) -> DataFrame:
    """sections plus ``file``: the indexed path that equals the diff's, or ends in it after a slash; the first in order of the alphabet."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    suffixes = g.files.select("path", F.explode(F.array_distinct(F.array_append(ends, F.col("path")))).alias("_key"))
    wanted = sections.withColumn("_key", F.regexp_replace(F.col(column), "^/", ""))
    hit = wanted.select("_key").distinct().join(suffixes, "_key").groupBy("_key").agg(F.min("path").alias("file"))
    return wanted.join(hit, "_key").drop("_key")


def affected_symbols(g: Graph, sections: DataFrame) -> DataFrame:
    """(diff_id, section, change, id, name, kind, file, is_exported): all symbols of added and deleted files, else those that a changed line or the hull of all changed lines meets.

    What is written is the sections; all of them meet the files, and their files the symbols, in one pass.
    """
    status = F.col("status")
    change = F.when(status == "added", "added").when(status == "deleted", "removed").otherwise("modified")
    asked = cut(sections).withColumns({"change": change, "_path": F.when(status == "deleted", F.col("old_file")).otherwise(F.col("new_file"))}).drop("status", "old_file", "new_file")
    files = _located(g, asked, "_path").drop("_path").join(g.paths, "file")
    symbols = g.symbols_by_file(*OWNER).join(files, "file_id")
    lines = F.concat("added", "removed")
    met = F.exists(lines, lambda x: x.between(F.col("line_start"), F.col("line_end"))) | ((F.col("line_start") <= F.col("line_max")) & (F.col("line_end") >= F.col("line_min")))
    return symbols.where((F.col("change") != "modified") | met).select("diff_id", "section", "change", "id", "name", "kind", "file", "is_exported")


def diff_impact(g: Graph, affected: DataFrame, depth: int = 2, many: bool = False) -> DataFrame:
    """affected plus direct, total, n_files (references from within the symbol itself left out) and risk: breaking, high or none. ``many``: at depth 1, affected may hold a large part of all symbols; it then runs once and is not written."""
    depth = max(1, min(5, depth))
    if depth == 1:
        counted = with_direct_counts(g, affected.where(F.col("id").isNotNull()), many)
        judged = counted.select("id", *[c for c in affected.columns if c != "id"], F.col("total").alias("direct"), "total", "n_files")
    else:
        affected = cut(affected)
        symbols = affected.select("id", "name", "file").distinct()
        judged = affected.join(impact_counts(symbols, dependents(g, symbols, depth, drop_self=True)).select("id", "direct", "total", "n_files"), "id")
    risk = F.when((F.col("change") == "removed") & (F.col("total") > 0), "breaking").when(F.col("total") > HIGH_IMPACT, "high").otherwise("none")
    return judged.withColumn("risk", risk)
