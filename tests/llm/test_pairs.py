import pytest

from codelode.llm.pairs import clean, describe, documented_functions, pairs_in_source, source_pairs

REAL = [
    ("sumHalves", "Sums both halves of the input."),
    ("x", "/** Waits for the lock.\n * Ties go to the earlier one. */"),
    ("load", "TODO: split this up. Moves the remaining work to the next worker."),
    ("f", "Liefert den ältesten Eintrag zurück."),
    ("f", "Возвращает самую широкую область."),
    ("f", "指定された行を並べ替えて返します"),
    ("f", "@brief Drops stale copies of the index"),
    ("f", "Licensed under MIT.\n\nReads the header of one frame."),
    ("f", "@param limit upper bound, zero for none"),
    ("f", 'Keeps "strings { unbalanced" apart.'),
]
TRIVIAL = [
    ("alignTree", "Align tree."),
    ("alignTree", "aligns the trees"),
    ("align_tree", "align_tree()"),
    ("f", "/** */"),
    ("f", '""""""'),
    ("f", "// -----"),
    ("f", "@param x\n@returns"),
    ("f", ":param x:\n:return:"),
    ("f", "Args:\n    a:\n    b:\nReturns:"),
    ("f", "TODO write docs"),
    ("f", "eslint-disable-next-line no-unused-vars"),
    ("f", "Code generated by tool v2. DO NOT EDIT."),
    ("f", "Copyright the authors. All rights reserved."),
    ("f", "const a = b();\nif (!a) return;"),
    ("f", "return f(x);"),
    ("f", "See above."),
    ("f", "Helper function"),
    ("f", "(non-Javadoc)"),
    ("f", " \n\t "),
]


@pytest.mark.parametrize("name,doc", REAL)
def test_real(name, doc):
    assert describe(doc, "f(x)", name)


@pytest.mark.parametrize("name,doc", TRIVIAL)
def test_trivial(name, doc):
    assert describe(doc, "f(x)", name) is None


def test_marks_are_cleaned():
    assert clean("/**\r\n * Reads.\r\n *\r\n */") == ["", "Reads.", "", ""]


def test_unbalanced_signatures_do_not_lose_a_pair():
    for signature in ("f(a", "f(a))", 'f(")")', "f(x: {a: b})", "(r *T) F(a int) (int, error)"):
        assert describe("Reads the whole frame.", signature, "f")


def test_source_text():
    text = '/** Adds two "{" up here. */\nint add(char *s = ")") { if (s == "}") { return 1; } return 2; }\n// TODO\nvoid nope() { }\n'
    assert pairs_in_source(text) == [('int add(char *s = ")")', 'Adds two "{" up here.', '{ if (s == "}") { return 1; } return 2; }')]


def test_table(spark):
    schema = "id long, name string, kind string, signature string, docstring string, description int"
    long = "Reads the frame header. " * 20000
    rows = [
        (1, "f", "function", "f()", "Reads the frame header.", 0), (1, "f", "function", "f()", "Reads the frame header.", 0), (2, "f", "class", "f()", "Reads the frame header.", 0),
        (3, None, "method", "f()", "Reads the frame header.", 0), (4, "f", "method", "  ", "Reads the frame header.", 0), (5, "f", "method", None, "x", 0), (6, "f", "method", "f()", None, 0),
        (7, "f", "method", "f()", "", 0), (8, "f", None, "f()", "Reads the frame header.", 0), (None, "f", "method", "f()", "Reads the frame header.", 0), (9, "f", "method", "f()", long, 0),
    ]
    got = documented_functions(spark.createDataFrame(rows, schema))
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 9]
    assert documented_functions(spark.createDataFrame([], schema)).count() == 0
    assert source_pairs(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), "id", "text").count() == 0


SOURCE = """
// Joins "a { b" with the rest,
// until both are empty.
function join(a, b = "}") {
  // inner { comment
  const s = "/** not a comment */ {";
  if (a) { return `${a} }`; }
  return { s };
}

/* plain block, no doc */
/** Adds two "{" up here. */
public int add(int x, int y) { return x + y; }

# Opens the socket.
def open(self):
    pass

async def fetch(url, retries=(1, 2)):
    \'\'\'Waits for the reply.

    Gives up after the last retry.
    \'\'\'
    while True:
        x = {"a": 1}

    return x

def fetch_all(urls):
    \'\'\'Fetch all.\'\'\'
    return 1

/** TODO */
void nope() { }
"""


def test_pairs_in_source_text():
    got = {s: (d, b) for s, d, b in pairs_in_source(SOURCE.replace("\\'", "'"))}
    assert set(got) == {'function join(a, b = "}")', "public int add(int x, int y)", "def open(self):", "def fetch(url, retries=(1, 2))"}
    description, body = got['function join(a, b = "}")']
    assert description == 'Joins "a { b" with the rest,\nuntil both are empty.' and body.endswith("return { s };\n}") and body.count("{") >= 5
    description, body = got["def fetch(url, retries=(1, 2))"]
    assert description.startswith("Waits for the reply.") and body.rstrip().endswith("return x") and "fetch_all" not in body


def test_the_captures_decide(monkeypatch):
    from codelode.llm import pairs

    assert pairs.read_pair("/** Reads. */", "(r *T) readAll(a int) error") == (["Reads."], "readAll")
    assert pairs.describe("Reads all.", "int readAll(int a)", "other") is None and pairs.describe("Opens the socket.", "open()", "open") == "Opens the socket."
    monkeypatch.setattr(pairs, "PAIR", pairs.regex.compile(r"(?P<line>)(?P<signature>)(?!)"))
    assert all(pairs.describe(d, "f(x)", n) is None for n, d in REAL)


def test_source_pairs_of_a_table(spark):
    rows = [(1, SOURCE.replace("\\'", "'"), 0), (1, SOURCE.replace("\\'", "'"), 0), (None, SOURCE, 0), (2, None, 0), (3, "no code", 0), (4, "// Counts the open slots.\nint slots() { return 1; }\n" * 3000, 0)]
    got = source_pairs(spark.createDataFrame(rows, "id long, text string, body int"), "id", "text")
    assert sorted(r["id"] for r in got.collect()) == [1, 1, 1, 1, 4]
    assert source_pairs(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0
