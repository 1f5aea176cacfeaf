"""Source texts to symbols, references and imports, line by line.

A file is cut into lines; each line is met with its language's patterns; nesting is told
by running sums of braces, or by indentation; ends and enclosing symbols are found by
windows over (file, nesting level). All of it is column expressions. It reads what one
line shows: a declaration whose name stands on a later line than its keyword is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import cut

# File extensions of the languages, tried in this order.
EXTENSIONS = {
    "typescript": [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"],
    "python": [".py", ".pyi"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"],
}
IGNORED = r"/(node_modules|dist|build|\.git|coverage|__pycache__|venv|\.venv|target|out|\.gradle|\.mvn)/"

_TS = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_RS = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
_JAVA = r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|synchronized|native|default|strictfp)\s+)*"
_C = r"^(?:(?:static|extern|inline|const|unsigned|signed|virtual|constexpr|explicit|friend)\s+)*"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|else|do|try|new|throw|await|super|sizeof|delete|case|typeof|using|typedef|struct|class|enum|union|namespace|template|goto|public|private|protected|package|import)\b)"
#: Per language (kind, pattern with the name in group 1, where it holds): any, top, or member of a class.
DECLARATIONS: dict[str, list[tuple[str, str, str]]] = {
    "typescript": [
        ("function", _TS + r"(?:async\s+)?function\s*\*?\s*([\w$]+)", "any"),
        ("class", _TS + r"class\s+([\w$]+)", "any"),
        ("interface", _TS + r"interface\s+([\w$]+)", "any"),
        ("enum", _TS + r"(?:const\s+)?enum\s+([\w$]+)", "any"),
        ("type", _TS + r"type\s+([\w$]+)[^=]*=", "any"),
        ("function", _TS + r"(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", "any"),
        ("variable", _TS + r"(?:const|let|var)\s+([\w$]+)", "any"),
        ("variable", r"^\s*(?:module\.)?exports\.([\w$]+)\s*=", "any"),
        ("method", r"^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?" + _NOT + r"([\w$#]+)\s*\([^;]*\)\s*(?::[^{]+)?\{", "member"),
        ("property", r"^\s*(?:(?:public|private|protected|static|readonly|declare|override)\s+)*" + _NOT + r"([\w$#]+)[?!]?\s*(?::[^=;(]+)?(?:=[^=>].*)?;\s*$", "member"),
    ],
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)", "any"), ("class", r"^\s*class\s+(\w+)", "any"), ("variable", r"^(?!__all__\b)(\w+)\s*(?::[^=]+)?=(?!=)", "top")],
    "go": [
        ("method", r"^func\s+\([^)]*\)\s*(\w+)", "any"),
        ("function", r"^func\s+(\w+)", "any"),
        ("interface", r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+interface\s*\{", "any"),
        ("class", r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+struct\s*\{", "any"),
        ("type", r"^type\s+(\w+)", "any"),
        ("variable", r"^(?:const|var)\s+(\w+)", "any"),
        ("variable", r"^package\s+(\w+)", "top"),
    ],
    "rust": [
        ("function", _RS + r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(\w+)", "any"),
        ("class", _RS + r"struct\s+(\w+)", "any"),
        ("enum", _RS + r"enum\s+(\w+)", "any"),
        ("interface", _RS + r"(?:unsafe\s+)?trait\s+(\w+)", "any"),
        ("type", _RS + r"type\s+(\w+)", "any"),
        ("variable", _RS + r"(?:const|static)\s+(?:mut\s+)?(\w+)\s*:", "any"),
        ("variable", _RS + r"mod\s+(\w+)", "any"),
    ],
    "java": [
        ("class", _JAVA + r"class\s+(\w+)", "any"),
        ("interface", _JAVA + r"interface\s+(\w+)", "any"),
        ("enum", _JAVA + r"enum\s+(\w+)", "any"),
        ("method", _JAVA + r"(?:<[^>]+>\s*)?(?:[\w.<>,?\[\]]+\s+)?" + _NOT + r"(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?\s*(?:\{|$)", "member"),
        ("method", _JAVA + r"(?:<[^>]+>\s*)?[\w.<>,?\[\]]+\s+" + _NOT + r"(\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w., ]+)?;\s*$", "member"),
        ("property", _JAVA + _NOT + r"[\w.<>,?\[\]]+\s+(\w+)\s*(?:=.*)?;\s*$", "member"),
        ("variable", r"^package\s+([\w.]+)", "top"),
    ],
    "c": [
        ("type", r"^\s*typedef\b.*?(\w+)\s*;\s*$", "any"),
        ("class", r"^\s*(?:typedef\s+)?(?:struct|union)\s+(\w+)\s*(?:\{|$)", "any"),
        ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)\s*(?:\{|$)", "any"),
        ("function", _C + _NOT + r"\w[\w\s*]*?[\s*]+(\w+)\s*\([^;={}]*\)\s*(?:[{;]|$)", "top"),
    ],
    "cpp": [
        ("type", r"^\s*typedef\b.*?(\w+)\s*;\s*$", "any"),
        ("type", r"^\s*using\s+(\w+)\s*=", "any"),
        ("enum", r"^\s*enum\s+(?:class\s+|struct\s+)?(\w+)", "any"),
        ("class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+(\w+)\s*(?:final\s*)?(?::[^:;]*)?(?:\{|$)", "any"),
        ("variable", r"^\s*(?:inline\s+)?namespace\s+(\w+)", "any"),
        ("method", r"^\s*(?:(?:static|virtual|inline|constexpr|explicit|friend)\s+)*(?:[\w:<>,*&\s]+?[\s*&]+)?" + _NOT + r"(~?\w+)\s*\([^;={}]*\)\s*(?:const|noexcept|override|final|\s|=\s*(?:0|default|delete))*(?:[{;]|$)", "member"),
        ("function", r"^\s*(?:template\s*<[^>]*>\s*)?(?:(?:static|inline|constexpr|extern)\s+)*" + _NOT + r"[\w:<>,*&]+(?:\s+[\w:<>,*&]+)*[\s*&]+([\w:~]+)\s*\([^;={}]*\)\s*(?:const|noexcept|\s)*(?:[{;]|$)", "any"),
        ("property", r"^\s*(?:(?:static|const|mutable)\s+)*" + _NOT + r"[\w:<>,*&]+(?:\s+[\w:<>,*&]+)*[\s*&]+(\w+)\s*(?:=.*)?;\s*$", "member"),
    ],
}
#: Per language (pattern, groups of source, name, local name; default and namespace flags); group 0 is "*", None the name.
IMPORTS: dict[str, list[tuple[str, int, int | None, int | None, int, int]]] = {
    "typescript": [
        (r"^\s*import\s+(?:type\s+)?\*\s+as\s+([\w$]+)\s+from\s+['\"]([^'\"]+)['\"]", 2, 0, 1, 0, 1),
        (r"^\s*import\s+(?:type\s+)?([\w$]+)\s*(?:,[^'\"]*)?\s+from\s+['\"]([^'\"]+)['\"]", 2, 1, 1, 1, 0),
        (r"^\s*export\s+\*\s+(?:as\s+[\w$]+\s+)?from\s+['\"]([^'\"]+)['\"]", 1, 0, 0, 0, 1),
        (r"^\s*(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", 2, 0, 1, 0, 1),
    ],
    "python": [(r"^\s*from\s+(\S+)\s+import\s+\*", 1, 0, 0, 0, 1), (r"^\s*import\s+([\w.]+)\s+as\s+(\w+)", 1, 1, 2, 0, 1), (r"^\s*import\s+([\w.]+)\s*$", 1, 1, 1, 0, 1)],
    "go": [(r"^(?:import)?\s*([\w.]+)\s+\"([^\"]+)\"\s*$", 2, 2, 1, 0, 0), (r"^(?:import)?\s*\"([^\"]+)\"\s*$", 1, 1, 1, 0, 0)],
    "rust": [(r"^\s*(?:pub\s+)?use\s+(.+)::\*\s*;", 1, 0, 0, 0, 1), (r"^\s*(?:pub\s+)?use\s+(?:(.+)::)?(\w+)\s+as\s+(\w+)\s*;", 1, 2, 3, 0, 0), (r"^\s*(?:pub\s+)?use\s+(.+)::(\w+)\s*;", 1, 2, 2, 0, 0)],
    "java": [(r"^\s*import\s+(?:static\s+)?([\w.]+)\.\*\s*;", 1, 0, 0, 0, 1), (r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", 1, 1, 1, 0, 0)],
    "c": [(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", 1, 1, 1, 0, 1)],
    "cpp": [(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", 1, 1, 1, 0, 1)],
}
#: Lists of names in braces or after import: (pattern, group of the source, group of the list).
NAME_LISTS = {
    "typescript": (r"^\s*(?:import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s+['\"]([^'\"]+)['\"]", 2, 1),
    "python": (r"^\s*from\s+(\S+)\s+import\s+\(?([^*()#]+)\)?", 1, 2),
    "rust": (r"^\s*(?:pub\s+)?use\s+(.+)::\{([^}]*)\}\s*;", 1, 2),
}
EXTENDS = {
    "typescript": [("extends", r"\bclass\s+[\w$]+(?:<[^>]*>)?\s+extends\s+([\w$.]+)")],
    "python": [("extends", r"^\s*class\s+\w+\s*\(([^)]*)\)")],
    "java": [("extends", r"\bclass\s+\w+(?:<[^>]*>)?\s+extends\s+([\w.]+)"), ("implements", r"\bimplements\s+([\w.,<> ]+?)\s*(?:\{|$)")],
    "cpp": [("extends", r"\b(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*([^{]+)")],
    "rust": [("implements", r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b")],
}
CALL = r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)!?\s*\("
NEW = r"\bnew\s+([A-Za-z_$][\w$.]*)"
KEYWORDS = "if for while switch catch return function elif else with match fn func def class sizeof not and or in is assert except lambda typeof await yield new print! super import require".split()
COMMENT = r"^\s*(?:///?!?|//!|/\*\*?|\*/?|#(?!\s*(?:include|define|if|endif|ifdef|ifndef|else|pragma|\[)))"


def language(path: Column) -> Column:
    """The language of a path's extension, null if none."""
    out = F.lit(None).cast("string")
    for lang in reversed(EXTENSIONS):
        out = F.when(reduce(lambda a, b: a | b, [path.endswith(e) for e in EXTENSIONS[lang]]), lang).otherwise(out)
    return out


def source_lines(sources: DataFrame) -> DataFrame:
    """(file, lang, line, text, bare, level, after, comment): the lines of (file, lang, content) with their nesting.

    bare is the line without strings and comments; level the nesting before the line,
    after the nesting behind it. In Python both are the indentation. One file is numbered
    in one task; files are independent. Null contents give no lines.
    """
    rows = sources.select("file", "lang", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("_p", "text")).withColumn("line", F.col("_p") + 1)
    by_file = Window.partitionBy("file").orderBy("line")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.regexp_replace("text", r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|`[^`]*`', '""')
    python = F.col("lang") == "python"
    bare = F.when(python, F.regexp_replace(quoted, r"#.*$", "")).otherwise(F.regexp_replace(F.regexp_replace(quoted, r"/\*.*?\*/", ""), r"//.*$", ""))
    rows = rows.withColumn("bare", bare)
    triple = F.size(F.split("text", '"""|\'\'\'')) - 1
    opened = F.when(python, triple).otherwise(F.size(F.split("bare", r"/\*")) - 1)
    closed = F.when(python, F.lit(0)).otherwise(F.size(F.split("bare", r"\*/")) - 1)
    rows = rows.withColumn("_o", opened).withColumn("_c", closed)
    inside = F.coalesce(F.sum(F.col("_o") - F.col("_c")).over(before), F.lit(0))
    rows = rows.withColumn("_in", F.when(python, inside % 2 == 1).otherwise(inside > 0)).withColumn("bare", F.when(F.col("_in"), "").otherwise(F.col("bare")))
    braces = F.length(F.regexp_replace("bare", r"[^{]", "")) - F.length(F.regexp_replace("bare", r"[^}]", ""))
    rows = rows.withColumn("_d", braces)
    indent = F.length(F.regexp_extract("text", r"^[ \t]*", 0))
    level = F.when(python, indent).otherwise(F.coalesce(F.sum("_d").over(before), F.lit(0)))
    return rows.select("file", "lang", "line", "text", "bare", level.cast("int").alias("level"), F.when(python, indent).otherwise(level + F.col("_d")).cast("int").alias("after"), (F.col("text").rlike(COMMENT) | (F.col("_in") & ~python)).alias("comment"))


def _first_declaration(members: bool) -> Column:
    """struct(kind, name, place) of the first pattern of the line's language that matches."""
    out = F.lit(None)
    for lang, rules in reversed(DECLARATIONS.items()):
        for kind, pattern, where in reversed(rules):
            if (where == "member") == members:
                holds = (F.col("lang") == lang) & F.col("bare").rlike(pattern) & (F.lit(True) if where != "top" else F.col("level") == 0)
                out = F.when(holds, F.struct(F.lit(kind).alias("kind"), F.regexp_extract("bare", pattern, 1).alias("name"))).otherwise(out)
    return out


def _enclosing(points: DataFrame, spans: DataFrame, strict: bool) -> DataFrame:
    """points (file, line, level, ...) plus ``within``: the innermost span that holds the line, a struct of its columns.

    The spans of one file and level do not overlap, so that the last one to start is the
    only one that can hold a line. Points ask at each level up to their own.
    """
    top = F.col("level") - (1 if strict else 0)
    asked = points.where(top >= 0).withColumn("_at", F.explode(F.sequence(F.lit(0), top))).withColumn("_span", F.lit(None).cast(spans.select(F.struct(*spans.columns).alias("s")).schema["s"].dataType))
    starts = spans.select("file", "line", F.col("level").alias("_at"), F.struct(*spans.columns).alias("_span"))
    both = starts.unionByName(asked, allowMissingColumns=True)
    last = F.last("_span", ignorenulls=True).over(Window.partitionBy("file", "_at").orderBy("line", F.col("_span").isNull().cast("int")))
    held = both.withColumn("_held", last).where(F.col("_span").isNull() & (F.col("_held.line_end") >= F.col("line")))
    keys = [c for c in points.columns]
    best = held.groupBy(*keys).agg(F.max_by("_held", "_at").alias("within"))
    return points.join(best.select("file", "line", *[c for c in ("pos", "name", "start") if c in keys], "within"), ["file", "line", *[c for c in ("pos", "name", "start") if c in keys]], "left")


def _spans(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found (file, line, level, ...) plus line_end: the line that closes what the line opens, or the line itself."""
    by_file = Window.partitionBy("file").orderBy("line")
    full = lines.where(F.trim("text") != "").withColumn("_prev", F.lag("level").over(by_file)).withColumn("_before", F.lag("line").over(by_file))
    python = F.col("lang") == "python"
    braces = full.where(~python & (F.col("after") < F.col("level"))).select("file", F.explode(F.sequence("after", F.col("level") - 1)).alias("level"), "line", F.col("line").alias("_end"))
    # A line that closes and opens again, such as "} else {", ends nothing of its own level.
    dedents = full.where(python & (F.col("level") <= F.col("_prev"))).select("file", F.explode(F.sequence("level", "_prev")).alias("level"), "line", F.col("_before").alias("_end"))
    ends = braces.unionByName(dedents)
    last = lines.where(F.trim("text") != "").groupBy("file").agg(F.max("line").alias("_last"))
    marks = found.withColumn("_end", F.lit(None).cast("int")).unionByName(ends, allowMissingColumns=True)
    after = F.first("_end", ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("line", F.col("_end").isNull().cast("int").alias("o")).rowsBetween(1, Window.unboundedFollowing))
    closed = marks.withColumn("_next", after).where(F.col("_end").isNull()).join(last, "file")
    # A brace may also follow on the next line.
    headed = F.col("kind").isin("function", "method", "class", "interface", "enum") & (F.col("lang") != "go")
    opens = (F.col("after") > F.col("level")) | (F.col("lang") == "python") | (headed & ~F.col("bare").rlike(r"[;{}]\s*$"))
    return closed.withColumn("line_end", F.when(opens & ((F.col("after") > F.col("level")) | (F.col("lang") == "python")), F.coalesce("_next", "_last")).when(opens, F.coalesce("_next", "line")).otherwise(F.col("line"))).drop("_end", "_next", "_last")


def _exported(c_like: Column) -> Column:
    name, text, lang = F.col("name"), F.col("text"), F.col("lang")
    return (
        F.when(lang == "typescript", text.rlike(r"^\s*(?:export\b|(?:module\.)?exports\b)"))
        .when(lang == "python", ~name.startswith("_") | name.startswith("__"))
        .when(lang == "go", name.rlike(r"^\p{Lu}") | text.startswith("package "))
        .when(lang == "rust", text.rlike(r"^\s*pub\b"))
        .when(lang == "java", text.rlike(r"\bpublic\b") | text.startswith("package "))
        .otherwise(~text.rlike(r"\bstatic\b") & c_like)
    ).cast("int")


def _docstrings(lines: DataFrame) -> DataFrame:
    """(file, line, doc): the run of comment lines that ends directly before a line, cleaned of its marks."""
    by_file = Window.partitionBy("file").orderBy("line")
    new_run = (F.col("comment") & ~F.coalesce(F.lag("comment").over(by_file), F.lit(False))).cast("int")
    runs = lines.withColumn("_run", F.sum(new_run).over(by_file)).where("comment")
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*(?:///?!?|//!|/\*\*?|\*/|\*|#!?)\s?", ""), r"\s*\*/\s*$", ""))
    per = runs.groupBy("file", "_run").agg(F.max("line").alias("_to"), F.array_sort(F.collect_list(F.struct("line", plain.alias("t")))).alias("_l"))
    kept = F.filter(F.transform("_l", lambda x: x["t"]), lambda t: t != "")
    return per.select("file", (F.col("_to") + 1).alias("line"), F.array_join(kept, "\n").alias("doc"))


def _inner_docstrings(lines: DataFrame) -> DataFrame:
    """(file, line, inner): Python strings on the line after a definition, up to where they close, however many lines on. Strings that never close give an empty one or no row."""
    by_file = Window.partitionBy("file").orderBy("line")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.where(F.col("lang") == "python").select("file", "line", F.trim("text").alias("t"), (F.lag(F.trim("bare")).over(by_file) != "").alias("_after"))
    held = [F.when(F.col("_after") & F.col("t").rlike(r"^[rRuU]?[\"']"), F.col("line"))]
    for quote in ('"""', "'''"):
        # The last line before this one that holds the quote: its number if it opens a string and leaves it open, else 0.
        opens = F.col("_after") & F.col("t").rlike(rf"^[rRuU]?{quote}(?!.*{quote})")
        held.append(F.last(F.when(F.col("t").contains(quote), F.when(opens, F.col("line")).otherwise(0)), ignorenulls=True).over(before))
    members = rows.select("file", "line", "t", F.array(*held).alias("_held")).select("file", "line", "t", F.explode(F.filter("_held", lambda x: x > 0)).alias("_from"))
    listed = F.array_sort(F.collect_list(F.struct("line", "t")))
    body = members.groupBy("file", "_from").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("body"))
    inner = F.regexp_extract("body", r'^[rRuU]?(?:"""([\s\S]*?)"""|\'\'\'([\s\S]*?)\'\'\'|"([^"\n]*)"|\'([^\'\n]*)\')', 0)
    told = F.trim(F.regexp_replace(inner, r'^[rRuU]?(?:"""|\'\'\'|"|\')|(?:"""|\'\'\'|"|\')$', ""))
    return body.select("file", (F.col("_from") - 1).alias("line"), told.alias("inner"))


def extract_symbols(lines: DataFrame) -> DataFrame:
    """(file, lang, ordinal, name, kind, line_start, line_end, col_start, col_end, level, parent_ordinal, signature, is_exported, docstring)."""
    code = lines.where(~F.col("comment") & (F.trim("bare") != ""))
    strong = code.withColumn("d", _first_declaration(False)).where(F.col("d").isNotNull()).select("file", "lang", "line", "level", "after", "text", "bare", "d.kind", "d.name")
    spans = cut(_spans(strong, lines))
    member = code.withColumn("d", _first_declaration(True)).where(F.col("d").isNotNull()).select("file", "lang", "line", "level", "after", "text", "bare", "d.kind", "d.name")
    around = spans.select("file", "line", "level", "line_end", F.col("kind").alias("outer"), F.col("name").alias("outer_name"))
    inside = _enclosing(member, around, strict=True).where(F.col("within.outer").isin("class", "interface", "enum") & (F.col("within.level") == F.col("level") - 1)).drop("within")
    # A line that both kinds of patterns match is a member only where a plain function could not stand.
    both = spans.join(inside.where(F.col("lang") == "cpp").select("file", "line"), ["file", "line"], "left_anti").unionByName(_spans(inside, lines).join(spans.where(F.col("lang") != "cpp").select("file", "line"), ["file", "line"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("line", "level", "name")) - 1
    numbered = cut(both.withColumn("ordinal", place))
    holders = numbered.select("file", "line", "level", "line_end", F.col("ordinal").alias("outer"), F.col("kind").alias("outer_kind"))
    nested = _enclosing(numbered, holders, strict=True)
    kind = F.when((F.col("lang") == "python") & (F.col("kind") == "function") & (F.col("within.outer_kind") == "class"), "method").otherwise(F.col("kind"))
    signature = F.trim(F.regexp_replace("text", r"\s*[{:;]?\s*$", ""))
    docs = nested.join(_docstrings(lines), ["file", "line"], "left").join(_inner_docstrings(lines), ["file", "line"], "left")
    docs = docs.join(lines.select("file", F.col("line").alias("line_end"), F.length(F.rtrim("text")).alias("col_end")), ["file", "line_end"], "left")
    doc = F.nullif(F.coalesce(F.nullif(F.col("inner"), F.lit("")), F.col("doc")), F.lit(""))
    return docs.select(
        "file", "lang", "ordinal", "name", kind.alias("kind"), F.col("line").alias("line_start"), "line_end", F.length(F.regexp_extract("text", r"^\s*", 0)).alias("col_start"), "col_end", "level",
        F.col("within.outer").alias("parent_ordinal"), signature.alias("signature"), _exported(~F.col("kind").isin("method", "property")).alias("is_exported"), doc.alias("docstring"),
    )


def extract_references(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, from_ordinal, to_symbol_name, to_symbol_bare_name, kind, line, col): calls, instantiations, extensions and implementations inside symbols."""
    code = lines.where(~F.col("comment") & (F.trim("bare") != ""))
    own = symbols.select("file", F.col("line_start").alias("line"), F.col("name").alias("own"))
    names = F.regexp_extract_all("bare", F.lit(CALL), F.lit(1))
    calls = code.select("file", "lang", "line", "level", F.explode(F.array_distinct(names)).alias("name"), F.lit("call").alias("kind"), "bare")
    fresh = code.select("file", "lang", "line", "level", F.explode(F.array_distinct(F.regexp_extract_all("bare", F.lit(NEW), F.lit(1)))).alias("name"), F.lit("instantiation").alias("kind"), "bare")
    literal = code.where(F.col("lang") == "go").select("file", "lang", "line", "level", F.explode(F.array_distinct(F.regexp_extract_all("bare", F.lit(r"(?<![\w.])(?:&)?([A-Z][\w.]*)\{"), F.lit(1)))).alias("name"), F.lit("instantiation").alias("kind"), "bare")
    macros = code.where(F.col("lang") == "rust").select("file", "lang", "line", "level", F.explode(F.array_distinct(F.regexp_extract_all("bare", F.lit(r"(\w+)!\s*[\[{]"), F.lit(1)))).alias("name"), F.lit("call").alias("kind"), "bare")
    bases = []
    for lang, rules in EXTENDS.items():
        for kind, pattern in rules:
            listed = F.split(F.regexp_replace(F.regexp_extract("bare", pattern, 1), r"<[^<>]*>|\b(?:public|private|protected|virtual)\b", ""), ",")
            named = code.where((F.col("lang") == lang) & F.col("bare").rlike(pattern)).select("file", "lang", "line", "level", F.explode(listed).alias("name"), F.lit(kind).alias("kind"), "bare")
            bases.append(named.withColumn("name", F.trim("name")).where((F.col("name") != "") & ~F.col("name").contains("=")))
    calls = calls.join(own, ["file", "line"], "left").where((F.col("own").isNull()) | (F.col("own") != F.col("name"))).drop("own")
    instantiated = F.col("bare").rlike(r"\bnew\s") & F.expr(r"bare rlike concat('\\bnew\\s+', regexp_replace(name, '([$.])', '\\\\$1'), '\\s*\\(')")
    calls = calls.where(~F.col("name").isin(*KEYWORDS) & ~instantiated & ~((F.col("lang") == "python") & F.col("bare").rlike(r"^\s*@")))
    points = reduce(DataFrame.unionByName, [calls, fresh, literal, macros, *bases]).select("file", "line", "level", "name", "kind").distinct().withColumnRenamed("name", "to_name").withColumn("name", F.concat_ws("\u0001", "kind", "to_name"))
    holders = symbols.select("file", F.col("line_start").alias("line"), "level", "line_end", F.col("ordinal").alias("outer"))
    # An impl block stands in no symbol; what it implements goes to the file's first one.
    orphaned = F.when(F.col("kind") == "implements", F.col("_first"))
    firsts = symbols.groupBy("file").agg(F.min("ordinal").alias("_first"))
    placed = _enclosing(points, holders, strict=False).join(firsts, "file").withColumn("_from", F.coalesce("within.outer", orphaned)).where(F.col("_from").isNotNull())
    texts = lines.select("file", "line", "text")
    placed = placed.join(texts, ["file", "line"]).withColumn("col", F.greatest(F.expr("locate(to_name, text)") - 1, F.lit(0)))
    return placed.select("file", F.col("_from").alias("from_ordinal"), F.col("to_name").alias("to_symbol_name"), F.substring_index("to_name", ".", -1).alias("to_symbol_bare_name"), "kind", "line", "col")


def extract_imports(lines: DataFrame) -> DataFrame:
    """(file, source_path, imported_name, local_name, is_default, is_namespace, line)."""
    text = F.col("text")
    out = []
    for lang, rules in IMPORTS.items():
        rest = lines.where((F.col("lang") == lang) & (text.rlike(r"^\s*(?:import|export|from|use|pub|#|const|let|var)\b|^\s*#\s*include") | ((F.col("lang") == "go") & text.rlike(r'^(?:import\b|\t|\s+)[\w. ]*"[^"]+"\s*$'))))
        taken: Column = F.lit(False)
        for pattern, source, name, local, default, namespace in rules:
            hit = rest.where(~taken & text.rlike(pattern))
            taken = taken | text.rlike(pattern)
            star = F.lit("*")
            last = F.substring_index(F.regexp_extract(text, pattern, source), "/", -1)
            value = lambda i: star if i == 0 else F.regexp_extract(text, pattern, i)
            local_name = value(local) if not (lang == "go" and local == source) else last
            if lang == "java" and name:
                local_name = F.substring_index(value(name), ".", -1)
            out.append(hit.select("file", value(source).alias("source_path"), value(name).alias("imported_name"), local_name.alias("local_name"), F.lit(default).alias("is_default"), F.lit(namespace).alias("is_namespace"), "line"))
    for lang, (pattern, source, listed) in NAME_LISTS.items():
        rows = lines.where((F.col("lang") == lang) & text.rlike(pattern))
        names = rows.select("file", "line", F.regexp_extract(text, pattern, source).alias("source_path"), F.explode(F.split(F.regexp_extract(text, pattern, listed), ",")).alias("_n")).withColumn("_n", F.trim(F.regexp_replace("_n", r"^\s*type\s+", ""))).where("_n <> ''")
        pair = F.split("_n", r"\s+as\s+")
        out.append(names.select("file", "source_path", F.trim(pair[0]).alias("imported_name"), F.trim(F.element_at(pair, -1)).alias("local_name"), F.lit(0).alias("is_default"), F.lit(0).alias("is_namespace"), "line"))
    return reduce(DataFrame.unionByName, out).distinct()


def scan_sources(sources: DataFrame) -> dict[str, DataFrame]:
    """symbols, references and imports of (file, content); files of other extensions or below ignored directories are left out, repeated paths read once."""
    known = sources.where(F.col("content").isNotNull() & ~F.col("file").rlike(IGNORED)).dropDuplicates(["file"]).withColumn("lang", language(F.col("file"))).where(F.col("lang").isNotNull())
    lines = cut(source_lines(known.select("file", "lang", F.col("content").cast("string").alias("content"))))
    symbols = cut(extract_symbols(lines))
    return {"symbols": symbols, "references": extract_references(lines, symbols), "imports": extract_imports(lines)}
