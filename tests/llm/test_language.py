import random

from codelode.llm.language import (
    NAMES, SAMPLE_CHARS, Automaton, Model, document_languages, fitted, known_names, language_segments, plain, prose, unlabelled_languages,
)

DOCS, SAMPLES = "doc_id long, text string, lang string, segment int", "sample_id long, lang string, text string"
SENTENCES = {
    "en": ["The reader keeps every row that it has seen before.", "Nobody knows why this part was written twice.", "Please ask before you delete the whole folder.", "There is no good reason to wait for the lock."],
    "de": ["Der Ordner enthält viele Dateien, die niemand mehr braucht.", "Bitte frag zuerst, bevor du das ganze Paket löschst.", "Niemand weiß, warum dieser Teil zweimal geschrieben wurde.", "Es gibt keinen guten Grund, auf die Sperre zu warten."],
    "fr": ["Le dossier contient beaucoup de fichiers dont personne n'a besoin.", "Demande d'abord avant de supprimer tout le paquet.", "Personne ne sait pourquoi cette partie a été écrite deux fois.", "Il n'y a aucune bonne raison d'attendre le verrou."],
}


def training(spark):
    return spark.createDataFrame([(i, k, t) for i, (k, ts) in enumerate(SENTENCES.items()) for t in ts] + [(9, None, "x"), (10, "en", None)], SAMPLES)


def test_automaton_follows_substrings():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abc") for _ in range(120))
    a = Automaton(text)
    for _ in range(300):
        part = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))
        state, ok = 0, True
        for c in part:
            state = a.next[state].get(c)
            if state is None:
                ok = False
                break
        assert ok == (part in text)

    def phrases(s):
        n, i = 0, 0
        while i < len(s):
            k = 1
            while i + k < len(s) and s[i : i + k + 1] in text:
                k += 1
            n, i = n + 1, i + k
        return n

    for _ in range(100):
        part = "".join(rnd.choice("abcd") for _ in range(30))
        assert round(a.cost(part) * len(part) / a.bits) == phrases(part)


def test_prose_leaves_out_code_and_headings():
    text = "# Overview\nOne sentence stands here.\n\n```\nlet x = 1. And this.\n```\n\n// A comment says this.\nconst x = f(3);\nfor (const e of x) {\n}\n\n> Quoted words are here.\n\n\tindented code. Yes.\n# Wrapped comment of\n# two whole lines.\n"
    assert [w.strip() for _, _, _, w, _ in prose(text)] == ["one sentence stands here", "a comment says this", "quoted words are here", "wrapped comment of two whole lines"]
    assert plain("`x` see HTTP://a.b and fooBar or a_b 12.").strip() == "see and or"


def test_segments_and_documents(spark):
    en, de, fr = (" ".join(SENTENCES[k]) for k in ("en", "de", "fr"))
    docs = [
        (1, en, "en", 0), (2, de, "en-US", 0), (3, f"{en}\n\n{de}", "English", 0), (4, fr, None, 0), (5, fr, "fr_CA", 0), (6, "", "en", 0), (7, None, "en", 0), (8, "x = 1;\ny();", "", 0), (None, de, "en", 0),
        (9, f"{en}\r\n\r\n> {fr}\r\n", "unknown", 0), (2, de, "en-US", 0), (10, (en + " ") * 500, "de", 0),
    ]
    docs = spark.createDataFrame(docs, DOCS)
    segments = language_segments(docs, training(spark))
    found = {(r["doc_id"], r["lang"]) for r in unlabelled_languages(segments, docs).collect()}
    assert found == {(2, "de"), (3, "de"), (4, "fr"), (9, "en"), (9, "fr"), (10, "en")}
    langs = {r["doc_id"]: (r["lang"], r["labelled"]) for r in document_languages(segments, docs).collect()}
    assert langs[2] == ("de", "en") and langs[5] == ("fr", "fr") and langs[6] == (None, "en") and langs[8] == (None, None)
    three = sorted((r["segment"], r["start"], r["end"], r["lang"]) for r in segments.where("doc_id = 3").collect())
    assert three == [(0, 0, len(en), "en"), (1, len(en) + 2, len(en) + 2 + len(de), "de")]
    assert all(0 <= r["confidence"] <= 1 for r in segments.collect())


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert language_segments(none, training(spark)).count() == 0
    assert language_segments(spark.createDataFrame([(1, "Some text here.", "en", 0)], DOCS), spark.createDataFrame([], SAMPLES)).count() == 0


def test_labels(spark):
    from pyspark.sql import functions as F

    from codelode.llm.language import named_language

    labels = [("EN", "en"), ("en-GB", "en"), ("deu", "de"), ("German", "de"), (" pt_BR ", "pt"), ("xx", None), ("", None), (None, None), ("und", None), ("-", None), ("n/a", None)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x, _ in labels], "l string").select(named_language(F.col("l"))).collect()]
    assert got == [y for _, y in labels] and set(NAMES) >= {"en", "ru"}


def test_many_sentences_are_judged_as_one_by_one():
    rnd = random.Random(2)
    texts = {k: "".join(plain(t) for t in ts) for k, ts in SENTENCES.items()}
    model, automata = Model(texts), {k: Automaton(t) for k, t in texts.items()}
    some = ["".join(rnd.choice("abcdeñß я") for _ in range(rnd.randrange(1, 60))) for _ in range(200)] + [plain(t) for ts in SENTENCES.values() for t in ts]
    costs = model.costs(some)
    assert all(abs(costs[i, j] - automata[k].cost(w)) < 1e-9 for i, k in enumerate(model.languages) for j, w in enumerate(some))
    assert model.judge_all(some)[-1][0] == "fr" and model.judge_all([]) == []


def test_short_sentences_count_if_they_are_clear(spark):
    docs = spark.createDataFrame([(1, "Niemand weiß warum.", "en", 0), (2, "Nobody knows why.", "de", 0), (3, "Ok.", "fr", 0)], DOCS)
    found = {(r["doc_id"], r["lang"]) for r in unlabelled_languages(language_segments(docs, training(spark)), docs).collect()}
    assert {(1, "de"), (2, "en")} <= found


def test_a_language_that_is_not_listed(spark):
    finnish = ["Kansiossa on paljon tiedostoja, joita kukaan ei enää tarvitse.", "Kysy ensin, ennen kuin poistat koko kansion.", "Kukaan ei tiedä, miksi tämä osa kirjoitettiin kahdesti.", "Ei ole mitään hyvää syytä odottaa lukkoa."]
    samples = training(spark).union(spark.createDataFrame([(20, "qfi", t) for t in finnish], SAMPLES))
    docs = spark.createDataFrame([(1, " ".join(finnish), "QFI-fi", 0), (2, " ".join(finnish), "en", 0), (3, " ".join(SENTENCES["en"]), "en", 0)], DOCS)
    names = known_names(samples)
    assert names["qfi"] == "qfi" and names["fi"].split()[0] == "fi"
    segments = language_segments(docs, samples)
    assert {(r["doc_id"], r["lang"]) for r in segments.select("doc_id", "lang").distinct().collect()} == {(1, "qfi"), (2, "qfi"), (3, "en")}
    assert {(r["doc_id"], r["lang"]) for r in unlabelled_languages(segments, docs, names=names).collect()} == {(2, "qfi")}


def test_the_sample_is_bounded_and_the_same_every_time(spark):
    docs = spark.createDataFrame([(i, f"{SENTENCES['en'][i % 4]} Number {i} is here too.", "en", 0) for i in range(3000)], DOCS)
    many = spark.range(100_001).selectExpr("id AS sample_id", "'en' AS lang", "concat('Sample text of number ', id, '.') AS text")
    samples = training(spark).unionByName(many)
    one, two = fitted(docs, samples), fitted(docs.repartition(7), samples.repartition(5))
    assert one == two and all(len(t) <= 3 * SAMPLE_CHARS for t in one.values())
