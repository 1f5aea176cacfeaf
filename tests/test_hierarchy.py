import random

import pytest

from codelode.operators import hierarchy
from codelode.operators.hierarchy import depths_and_roots, full_hierarchy

SCHEMA = "id long, parent_symbol_id long, depth string"


def brute(rows):
    parent = {}
    for v, p, _ in rows:
        if v is not None:
            old = parent.get(v)
            parent[v] = p if old is None else old if p is None else min(old, p)
    out, paths = {}, {}
    for v in parent:
        seen, path, u = set(), [v], v
        while parent[u] in parent and u not in seen:
            seen.add(u)
            u = parent[u]
            path.append(u)
        endless = u in seen and parent[u] in parent
        paths[v] = None if endless else path[::-1]
        if parent[v] in parent:
            out[v] = (-1, -1) if endless else (u, len(path) - 1)
    return out, paths


def forest(seed, n=120):
    rnd = random.Random(seed)
    rows = [(1, None, "x")]
    for i in range(2, n):
        rows.append((i, rnd.choice([None, i - 1, i - 1, rnd.randrange(1, i), 10_000 + i]), "x"))
    rows += [(900, 901, "x"), (901, 902, "x"), (902, 900, "x"), (903, 902, "x"), (904, 903, "x"), (905, 905, "x"), (None, 1, "x"), (-7, 1, "x")]
    rnd.shuffle(rows)
    return rows + rows[:30]


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_equal_brute_force(spark, seed):
    rows = forest(seed)
    want, _ = brute(rows)
    got = {r["id"]: (r["root_id"], r["depth"]) for r in depths_and_roots(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_deep_chain_and_long_family(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "RUN_BITS", 3)  # many runs of siblings
    rows = [(i, i - 1 if i > 1 else None, "x") for i in range(1, 70)] + [(1000 + i, 5, "x") for i in range(60)]
    want, _ = brute(rows)
    assert {r["id"]: (r["root_id"], r["depth"]) for r in depths_and_roots(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_paths_and_descendants(spark):
    rows = forest(3, 60)
    want, paths = brute(rows)
    got = {r["id"]: r for r in full_hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(paths)
    for v, r in got.items():
        assert r["path"] == paths[v]
        below = {u for u, p in paths.items() if p and v in p[:-1]}
        if paths[v] is None:
            assert r["status"] in ("on_cycle", "below_cycle")
            continue
        assert r["n_descendants"] == len(below)
        inside = {u for u, q in got.items() if q["root_id"] == r["root_id"] and q["tour_in"] is not None and r["tour_out"] < q["tour_in"] < r["tour_in"]}
        assert inside == below
    assert {v for v, r in got.items() if r["status"] == "on_cycle"} == {900, 901, 902, 905}


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert depths_and_roots(df).count() == 0 and full_hierarchy(df).count() == 0
