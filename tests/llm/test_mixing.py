import random

from codelode.llm.mixing import VOCABULARY, _encoder, mix

DOCS, TARGETS = "doc_id long, source string, text string, copies int", "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice(["Issue", " issue", "wiki", "source-file", "Source_File", None, "other"]), "word " * rnd.randrange(0, 60), 0) for i in range(800)]
    docs += [(900, "issue", None, 0), (901, "issue", "", 0), (None, "issue", "x", 0), docs[0]]
    targets = [("issue", 0.5, 1), ("Wiki ", 0.3, 3), ("source_file", 0.1, 2), ("forum", 0.1, 2), (None, 0.5, 1), ("bad", None, 1), ("bad", -1.0, 1), ("bad", 0.2, 0)]
    uses, report = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    rows = {r["doc_id"]: r for r in uses.collect()}
    assert set(rows) == {d[0] for d in docs if d[0] is not None} and len(rows) == uses.count()
    caps = {"issue": 1, "wiki": 3, "source_file": 2}
    assert all(0 <= r["copies"] <= caps.get(r["source"], 0) for r in rows.values())
    encode = _encoder(VOCABULARY).encode_ordinary
    assert all(rows[d[0]]["tokens"] == len(encode(d[2] or "")) for d in docs if d[0] is not None)
    told = {r["source"]: r for r in report.collect()}
    assert set(told) == {"issue", "wiki", "source_file", "forum"} and told["forum"]["tokens"] == 0
    total = sum(r["copies"] * r["tokens"] for r in rows.values())
    for s, share in (("issue", 0.5 / 0.9), ("wiki", 0.3 / 0.9), ("source_file", 0.1 / 0.9)):
        assert abs(told[s]["tokens"] - share * total) < 150  # about a document
        assert abs(told[s]["reached_share"] - told[s]["tokens"] / total) < 1e-9
        assert told[s]["tokens"] == sum(r["copies"] * r["tokens"] for r in rows.values() if r["source"] == s)


def test_one_source_and_a_given_size(spark):
    docs = [(i, "a", "some words here", 0) for i in range(100)]
    uses, report = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 1.0, 4)], TARGETS), total_tokens=300)
    assert report.first()["tokens"] in (300, 303)


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    uses, report = mix(spark.createDataFrame([], DOCS), targets)
    assert uses.count() == 0 and report.first()["reached_share"] == 0
    uses, report = mix(spark.createDataFrame([(1, "a", "x", 0)], DOCS), spark.createDataFrame([], TARGETS))
    assert uses.first()["copies"] == 0 and report.count() == 0
