import random

import numpy as np
import pytest

from codelode.llm.leaks import Plan, edit_distance, leaked_passages, walks_for, words

DOCS, ITEMS = "doc_id long, text string, at int, win string", "item_id long, text string, n int"


def brute(docs, items):
    def windows(t, n):
        w = words(t)
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    out = set()
    for i, t in {(r[0], r[1]) for r in items if r[0] is not None and r[1]}:
        n = min(13, len(words(t)))
        own = set(windows(t, n)) if n else set()
        out |= {(r[0], i) for r in docs if r[0] is not None and r[1] and own & set(windows(r[1], n))}
    return out


def corpus(seed=0):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Straße", "ÉTÉ", "x1"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([5, 12, 13, 20, 40])), 0) for i in range(30)] + [(30, None, 0), (31, "", 0), (32, "...", 0), (None, "a b", 0)]
    items += [(33, items[3][1], 0), items[3]]
    docs = []
    for d in range(120):
        body = text(rnd.choice([0, 3, 60, 200])).split()
        if d % 2:
            w = items[rnd.randrange(30)][1].split()
            k = rnd.choice([len(w), 13, 12])
            part = w[:k]
            dress = rnd.choice(["plain", "upper", "lines"])
            part = [x.upper() for x in part] if dress == "upper" else part
            body[5:5] = ["\n# ".join(part)] if dress == "lines" else part
        docs.append((d, " ".join(body), 1, "x"))
    return docs + [(500, None, 1, "x"), (501, "", 1, "x"), (None, items[0][1], 1, "x"), (502, items[3][1], 1, "x"), docs[1], (503, "filler " * 50000 + items[4][1], 1, "x")], items


def test_equal_windows_are_all_found(spark):
    docs, items = corpus()
    got = {(r["doc_id"], r["item_id"]) for r in leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where("edits = 0").collect()}
    assert got == brute(docs, items) and len(got) > 30


def one_edit_apart(docs, items, most=1):
    """All pairs whose item has a window at most one edit from some stretch of the document, by brute force."""
    out = set()
    for i, t, _ in items:
        w = np.array([hash(x) for x in words(t)])
        n = min(13, len(w))
        own = np.stack([w[k : k + n] for k in range(len(w) - n + 1)])
        for d, body, _, _ in docs:
            v = np.array([hash(x) for x in words(body)])
            for m in (n - 1, n, n + 1):
                if len(v) < m:
                    continue
                there = np.stack([v[k : k + m] for k in range(len(v) - m + 1)])
                if edit_distance(np.repeat(own, len(there), 0), np.tile(there, (len(own), 1)), 1).min() <= most:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("edit", ["swap", "drop", "add"])
def test_recall_one_edit_away_at_every_place(spark, edit):
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(9000)]
    items, docs = [], []
    for size in (6, 8, 13, 20, 40):
        for at in range(size):
            for _ in range(max(1, 40 // size)):
                w = rnd.sample(vocab, size)
                items.append((len(items), " ".join(w), 0))
                w = w[:at] + {"swap": ["other"], "drop": [], "add": [w[at], "other"]}[edit] + w[at + 1 :]
                docs.append((len(docs), " ".join(["before", *w, "after"]), 0, ""))
    got = {(r["doc_id"], r["item_id"]) for r in leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    for size in (6, 8, 13, 20, 40):
        mine = [i for i in items if len(i[1].split()) == size]
        want = set().union(*(one_edit_apart([docs[i[0]]], [i]) for i in mine))
        # Every edit is one that the brute force sees too.
        assert len(want) == len(mine)
        assert len(got & want) >= 0.9 * len(want), (size, len(got & want), len(want))
    assert all(a == b for a, b in got)


def test_blocks_give_what_one_filter_gives(spark):
    docs, items = corpus(3)
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one, many = (sorted(map(tuple, leaked_passages(docs, items, filter_bits=b).collect())) for b in (1 << 27, 1 << 14))
    assert one == many


def test_walks_grow_with_the_recall():
    assert walks_for([6, 13], Plan(target_recall=0.7)) <= walks_for([6, 13], Plan(target_recall=0.97)) and walks_for([3], Plan()) == 1


def test_edit_distance():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
            d = e
        return d[-1]

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (200, 8)), rng.integers(0, 3, (200, 8))
    assert edit_distance(a, b).tolist() == [slow(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_empty(spark):
    docs, items = corpus()
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaked_passages(none[0], spark.createDataFrame(items, ITEMS)).count() == 0
    assert leaked_passages(spark.createDataFrame(docs, DOCS), none[1]).count() == 0
