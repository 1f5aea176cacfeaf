import random
from collections import defaultdict

from codelode.operators.skew import heavy_keys, keyed_counts, spread_join

SCHEMA = "id long, k string, kind string, who long, line int, _salts string"


def _rows(n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else rnd.choice([None, "", "a", "b", f"k{i % 40}"])
        rows.append((i, key, rnd.choice(["call", "new"]), rnd.choice([None, *range(9)]), i % 50, "x"))
    return rows + rows[:100] + [(None, "hot", "call", 1, 1, "x")]


def test_counts_equal_brute_force(spark):
    rows = _rows()
    want = defaultdict(dict)
    for i, k, kind, who, line, _ in rows:
        if i is not None:
            want[(k, kind)][i] = (who, line)
    got = keyed_counts(spark.createDataFrame(rows, SCHEMA), ["k", "kind"], "id", "who", ["line"], share=0.02).collect()
    assert len(got) == len(want)
    for r in got:
        have = want[(r["k"], r["kind"])]
        lines = [x[1] for x in have.values()]
        assert (r["n_rows"], r["n_members"], r["min_line"], r["max_line"]) == (len(have), len({w for w, _ in have.values() if w is not None}), min(lines), max(lines))


def test_counts_do_not_depend_on_the_salting(spark):
    df = spark.createDataFrame(_rows(seed=2), SCHEMA)
    one = sorted(map(str, keyed_counts(df, ["k", "kind"], "id", share=1.0).collect()))
    many = sorted(map(str, keyed_counts(df, ["k", "kind"], "id", share=0.001).collect()))
    assert one == many


def test_no_rows(spark):
    assert keyed_counts(spark.createDataFrame([], SCHEMA), ["k"], "id", "who").count() == 0


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame([("a",)] * 90 + [(f"x{i}",) for i in range(10)], "k string")
    assert [(r["k"], r["_salts"]) for r in heavy_keys(df, ["k"], 0.1).collect()] == [("a", 9)]


def test_spread_join_equals_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 5 else None) for i in range(200)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("z", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, spread_join(left, right, ["k"], how, ["id"], 0.05).collect())) == sorted(map(str, left.join(right, "k", how).select(spread_join(left, right, ["k"], how, ["id"], 0.05).columns).collect())), how
