"""Functions paired with their documentation."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import spread_out

# A record or a source text is read as: comment, signature, body. Brackets are matched by
# recursion, and what stands in quotes is passed over whole, so a brace or comment mark
# inside a string neither opens nor closes anything. The lines of a comment are captured
# without their marks. \x02 ... \x03 frame the documentation of a record, whose own marks
# may be missing or unbalanced.
GRAMMAR = r"""
    (?(DEFINE)
      (?P<quoted> "(?:\\.|[^"\\\n])*+" | '(?:\\.|[^'\\\n])*+' | `(?:\\.|[^`\\])*+` )
      (?P<note> /\*.*?\*/ | //[^\n]*+ )
      (?P<round> \( (?: [^()"'`/]++ | (?&quoted) | (?&note) | (?&round) | ["'`/] )*+ \) )
      (?P<curly> \{ (?: [^{}"'`/]++ | (?&quoted) | (?&note) | (?&curly) | ["'`/] )*+ \} )
      (?P<opening> [^\S\n]*+ (?: /\*+!? | \*+/ | \"{3} | '{3} | //[/!]? | --+(?=\s|$|\x03) | \#+!? | \*+ | ;+ | %+ | <!-- ) )
      (?P<closing> [^\S\n]*+ (?: \*+/ | --> | \"{3} | '{3} ) )
    )
"""
LINE = r"""(?: (?: (?= \s*+ [/*"'\#;%<-] ) (?&opening) )*+ [^\S\n]*+ (?P<line> (?: [^\s\x03*"'-]++ | [ ] (?= [^\s\x03*"'-] ) | (?! (?&closing)++ [^\S\n]*+ [\n\x03] ) [^\n\x03] )*+ ) (?: (?= \s*+ [*"'-] ) (?&closing) )*+ [^\S\n]*+ )"""
PAIR = regex.compile(
    r"(?msx)"
    + GRAMMAR
    + rf"""
    (?P<comment>
        \x02 {LINE} (?= [\n\x03] ) (?: \n {LINE} (?= [\n\x03] ) )*+ \x03
      | ^[ \t]*+ (?= /\*\* ) (?P<block> /\*\* .*? \*/ )
      | (?P<block> (?: ^[ \t]*+ (?: // | \# | -- ) [^\n]*+ \n )++ )
    )
    \s*+
    (?P<signature> (?: (?&quoted) | (?&round) | [^\n{{;\x02\x03] )++ )
    \s*+
    (?P<body> (?&curly) )?+
    """
)
# The same for a string that follows the signature, its body being what is indented as the string is.
INSIDE = regex.compile(
    r"(?msx)"
    + GRAMMAR
    + r"""
    ^(?P<outer> [ \t]*+ ) (?: async [ ]+ )?+ (?P<signature> def [ ]++ \w++ \s*+ (?&round) [^\n:]*+ ) : [^\n]*+ \n
    (?P<inner> (?P=outer) [ \t]++ ) [rRuU]?+ (?P<block> \"{3} (?: \\. | (?! \"{3} ) . )*+ \"{3} | '{3} (?: \\. | (?! '{3} ) . )*+ '{3} )
    (?P<body> (?: \n (?: (?P=inner) [^\n]*+ | [ \t]*+ (?=\n) ) )*+ )
    """
)
#: Of a source text only signatures of this form count: a named thing with a parameter list.
CALLABLE = regex.compile(r"(?x) (?(DEFINE) (?P<round> \( (?: [^()]++ | (?&round) )*+ \) )) (?P<name>[\w$~]+) \s* (?: <[^()]*> )? \s* (?&round)")

TOOLS = regex.compile(
    r"(?i)^\W*(?:eslint|pylint|flake8|noqa|nolint|mypy|pyright|type:\s*ignore|prettier|clang-|clang:|ts-|@ts-|tslint|jshint|jslint|stylelint|istanbul|c8 ignore|v8 ignore"
    r"|coverage:|pragma|nosonar|nosec|rubocop|checkstyle|spotless|spotbugs|noinspection|fmt:|yapf:|isort:|ruff:|black:|biome-|deno-|swiftlint|ktlint|detekt|phpcs|phpstan|psalm"
    r"|vim:|-\*-|go:|\+build|cspell|codespell|lint[: -]|webpack|@vite|region\b|endregion\b|sourcemappingurl)"
)
GENERATOR = regex.compile(
    r"(?i)\bauto-?\s?generated\b|@generated\b|\bcode generated\b|\bgenerated (?:by|from|with|using|automatically|code|file|at|on)\b|\b(?:automatically|was|is|been|machine) generated\b"
    r"|\bdo not (?:edit|modify|change)(?:\W*$|\s+(?:this|manually|by hand|directly))|\bDO NOT EDIT\b|\b(?:erzeugt|generiert) (?:durch|von|mit)\b|\bnicht (?:von hand|manuell) ändern\b"
    r"|\bgénéré (?:par|automatiquement)\b|\bgenerado (?:por|automáticamente)\b|\bgerado (?:por|automaticamente)\b|\bgenerato (?:da|automaticamente)\b|\bgegenereerd door\b|\bwygenerowan\w+ (?:przez|automatycznie)\b|\bсгенерирован\w*\b|\bgenererad av\b"
)
LICENCE = regex.compile(
    r"(?i)\bcopyright\b|©|\(c\)\s*\d{4}|\blicen[cs]ed? under\b|\ball rights reserved\b|\bSPDX-|\bgoverned by\b.*\blicen[cs]e|\bpermission is hereby granted\b|\bwithout warrant(?:y|ies)\b|\bredistribution and use\b|\blicen[cs]e (?:file|version|agreement)\b"
)
LATER = regex.compile(r"(?:\b(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b|(?i:\b(?:todo|fixme)\s*[:(]|@todo\b|^\W*(?:todo|fixme|tbd|wip)\b)).*", regex.S)
TAG = regex.compile(r"^\s*(?:[@\\](?P<tag>\w+)|:(?P<tag>\w+)(?P<args>[^:\n]*):|\{@(?P<tag>\w+)[^}]*\})\s*(?P<rest>.*)$", regex.S)
SECTION = regex.compile(r"(?i)^\s*(?:args|arguments|params|parameters|returns?|yields?|raises|throws|notes?|examples?|attributes)\s*:?\s*$")
FIELD = regex.compile(r"^\s*[\w$.*]+(?:\s*\([^)]*\))?\s*:\s*(?P<rest>.*)$")
CODE_HEAD = r"(?:const|let|var|return|if|else|for|while|import|from|def|func|fn|class|public|private|static|switch|case|try|catch|throw|raise|new|await|self\.|this\.)"
CODE = regex.compile(
    r"(?x) (?(DEFINE) (?P<round> \( (?: [^()]++ | (?&round) )*+ \) ))"
    rf"^\s* (?: {CODE_HEAD} .* [;{{}}:=(] .* | [\w.$\[\]]+ \s* (?:[-+*/|&]?=|:=)(?!=) .* | .* [(){{}}\[\]=<>] .* [;{{}}] | [\w.$:]+ \s* (?&round) \s* ;? | [{{}}\[\]();]+ ) \s*$"
)
PARAMETER_TAGS = {"param", "parameter", "arg", "argument", "type", "rtype", "tparam", "property", "prop", "raises", "raise", "throws", "exception", "returns", "return", "yields", "retval"}
TEXT_TAGS = {"brief", "summary", "description", "desc", "remarks", "remark", "details", "note", "short"}

# Words that would fit any function, so that they tell nothing about this one.
GENERIC = frozenset(
    """a an the this that these those it its is are was were be been being to of for in on at by with from as and or not no nor if then than so but do does did done doing has have had
    will would should can could may might must shall here there above below see also same like such etc via per function functions func method methods procedure routine subroutine constructor ctor
    destructor getter setter accessor mutator helper helpers utility util utils wrapper stub implementation implementations implement implements implemented impl class module file code thing things stuff
    something anything everything somehow someone work works working job task tasks main internal private public protected external static abstract virtual default deprecated obsolete legacy unused non
    use uses used using usage only auto autogenerated generated generate javadoc docstring doc docs documentation document documents documented comment comments describe describes description desc summary
    brief overview note notes placeholder missing available add write insert put fill update me please later soon yet fix todo fixme tbd xxx hack wip ok okay none null nil na n yes test testing asdf foo
    bar baz qux lorem ipsum dolor sit amet short long goes needed required optional return returns returned param params parameter parameters arg args argument arguments result results value values type
    types name named names self explanatory obvious trivial simple basic generic general new old temp tmp misc various perform performs performed performing execute executes run runs call calls called
    invoke invokes handle handles handler process processes what how why when where which who whatever magic happen happens callback entry point override overrides overridden inherit inherits inherited
    inheritdoc parent base super superclass interface event operation operations action actions behaviour behavior logic purpose nothing progress say says said actual proper special certain given specific
    funktion methode hilfsfunktion hilfsmethode beschreibung fehlt folgt siehe oben konstruktor fonction méthode auxiliaire voir constructeur manquante función método auxiliar ver arriba falta constructor
    função descrição funzione metodo descrizione costruttore vedi sopra functie hulpfunctie beschrijving ontbreekt zie boven funkcja metoda pomocnicza opis brak konstruktor funktionen metod hjälpfunktion
    beskrivning saknas функция метод вспомогательная описание отсутствует смотри выше конструктор""".split()
)
WORD = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{L}\p{M}*[\p{L}\p{M}]*")
DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
FRAME = {2: " ", 3: " ", 13: "\n"}
LETTER = regex.compile(r"\p{L}")
#: What a tag for a parameter, or another one, may say that explains nothing: a type in braces, the bare name.
NAMED, TYPED = regex.compile(r"^\s*(?:\{[^}]*\}\s*)?[\[\w$.*\]=]+\s*[-:]?"), regex.compile(r"^\s*(?:\{[^}]*\}\s*)?")
SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+")


def stem(word: str) -> str:
    w = word.casefold()
    # A plural or a verb's third person may hide a further ending, as in "renders".
    for ends in ((("ies", 5), ("es", 4), ("s", 3)), (("ing", 5), ("ed", 4), ("er", 5), ("or", 5))):
        for end, least in ends:
            if w.endswith(end) and len(w) >= least + 1:
                w = w[: -len(end)]
                break
        w = w.rstrip("e") or w
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w.rstrip("eyi") or w


def telling(text: str, own: set[str]) -> int:
    """How many words of the text are neither generic nor from the function's own name."""
    n = len(DENSE.findall(text)) // 2
    for w in WORD.findall(DENSE.sub(" ", text)):
        if len(w) > 1 and w.casefold() not in GENERIC and stem(w) not in own:
            n += 1
    return n


def informative(lines: list[str], *names: str) -> bool:
    """Whether some part of the comment says something about this function."""
    own = {stem(w) for name in names for w in WORD.findall(name)} | {name.casefold() for name in names}
    runs: list[str] = []
    joined = False
    for line in lines:
        tag, field = TAG.match(line), FIELD.match(line)
        if not LETTER.search(line) or TOOLS.match(line) or SECTION.match(line) or CODE.match(line):
            joined = False
        elif tag:
            kind, rest = tag["tag"].lower(), tag["rest"]
            if kind in PARAMETER_TAGS:
                # The tag's own arguments, a type in braces or a bare name, explain nothing.
                rest = (NAMED if kind.startswith(("par", "arg", "tp", "prop")) and not tag["args"] else TYPED).sub("", rest)
            elif kind not in TEXT_TAGS:
                rest = ""
            runs.append(rest)
            joined = bool(rest)
        elif field and len(line.split(":")[0].split()) == 1:
            runs.append(field["rest"])
            joined = True
        elif joined:
            runs[-1] += " " + line
        else:
            runs.append(line)
            joined = True
    for run in runs:
        for sentence in SENTENCE.split(run):
            if GENERATOR.search(sentence) or LICENCE.search(sentence) or TOOLS.match(sentence) or CODE.match(sentence):
                continue
            if telling(LATER.sub("", sentence), own):
                return True
    return False


def read_pair(docstring: str, signature: str) -> tuple[list[str], str]:
    """(lines, name): the lines of a record's documentation without their marks, and the name that its signature declares, both as PAIR captures them from its comment and signature put together."""
    frame = docstring.replace("\r\n", "\n").translate(FRAME)
    m = PAIR.match(f"\x02{frame}\x03\n{signature.strip()}\n")
    if not m:
        return [], ""
    called = CALLABLE.search(m["signature"])
    return [line.strip() for line in m.captures("line")], called["name"] if called else ""


def clean(text: str) -> list[str]:
    """The lines of a documentation comment without their comment marks."""
    return read_pair(text, "f()")[0]


def describe(docstring: str, signature: str, name: str) -> str | None:
    """The cleaned documentation of one record, or None if it is trivial. Its own name is both that of the record and the one its signature declares."""
    lines, declared = read_pair(docstring, signature)
    return "\n".join(lines).strip() if informative(lines, declared, name) else None


def pairs_in_source(text: str) -> list[tuple[str, str, str]]:
    """(signature, description, body) of each documented function in one source text."""
    out = []
    for m in [*PAIR.finditer(text or ""), *INSIDE.finditer(text or "")]:
        signature = m["signature"].strip()
        called = CALLABLE.search(signature)
        if not called or not m["block"]:
            continue
        lines, _ = read_pair(m["block"], signature)
        if informative(lines, called["name"]):
            out.append((signature, "\n".join(lines).strip(), m["body"] or ""))
    return out


def documented_functions(symbols: DataFrame) -> DataFrame:
    """(id, signature, description) of functions and methods whose documentation says something.

    Rows of other kinds, without id, or with a null or blank signature or docstring are
    left out; so are trivial docstrings, that is those of which no sentence has a word
    beyond the function's own name and generic ones once comment marks, rule lines,
    placeholders, bare tags, notes to tools or from generators, licence notes and code
    are gone. Rows delivered twice come out once; a null name has no words. Texts of any
    length are read whole. An empty table gives no rows.
    """
    rows = symbols.select("id", "name", "kind", "signature", "docstring").where(
        F.col("kind").isin("function", "method") & F.col("id").isNotNull() & F.col("signature").rlike(r"(?U)\S") & F.col("docstring").rlike(r"(?U)\S")
    )

    @F.pandas_udf("string")
    def description(doc: pd.Series, signature: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([describe(d, s, n or "") for d, s, n in zip(doc, signature, name)], dtype=object)

    told = rows.select("id", "signature", description("docstring", "signature", "name").alias("description"))
    return told.where(F.col("description").isNotNull()).dropDuplicates(["id"])


def source_pairs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signature, description, body) of the documented functions in whole source texts.

    Null and empty texts and null keys give none, texts delivered twice equal rows once.
    Functions without a comment before them, or a string within, and those whose comment
    is trivial are left out. A text may mix prose and code of several languages.
    """

    @F.pandas_udf("array<struct<signature:string,description:string,body:string>>")
    def found(t: pd.Series) -> pd.Series:
        return pd.Series([[{"signature": s, "description": d, "body": b} for s, d, b in pairs_in_source(x)] for x in t], dtype=object)

    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_text"))
    return spread_out(rows, key).select(F.col(key), F.explode(found("_text"))).select(key, "col.*").distinct()
