"""What lies above, below and ahead, beside walks in plain Python."""

import random

import pytest

from veilframe.operators import graphs, jobs


def forest(seed, n=60):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(max(0, i - 6), i), 900 + i % 3]) if i else None, rng.choice(["a", "b", "c", None])) for i in range(n)]
    chain = [(1000 + i, 999 + i if i else None, "z" if i == 40 else "y") for i in range(41)]
    return rows + chain


def above(parent, i):
    out = []
    while parent.get(i) is not None:
        i = parent[i]
        out.append(i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_like_walks(spark, seed):
    rows = forest(seed)
    parent = {i: p for i, p, _ in rows}
    df = spark.createDataFrame(rows, "id long, parent_id long, dir string").repartition(3)
    roots = [0, 5, 17, 30, 901, 1000, 1020, 5000]
    r = spark.createDataFrame([(x,) for x in [*roots, 5, None]], "id long")
    want = sorted({(x, x) for x in roots} | {(x, i) for i in parent for x in roots if x in above(parent, i)})
    assert sorted(map(tuple, graphs.subtree(df, r).collect())) == want
    assert {x.id: x.root for x in graphs.tops(df).collect()} == {i: (above(parent, i) or [i])[-1] for i in parent}
    known = {i: sorted({d for j, _, d in rows if d and (i == j or i in above(parent, j))}) for i in parent}
    assert {x.id: x["values"] for x in graphs.below(df, "dir").collect() if x.id in known} == known
    near = {x.id: (x.above, x.found) for x in graphs.climbed(df, r).collect()}
    first = {i: next(((x, True) for x in above(parent, i) if x in roots), ((above(parent, i) or [None])[-1], False)) for i in parent if parent[i] is not None}
    assert near == first
    gone = jobs.purged(df.selectExpr("*", "case dir when 'a' then 'bypassed' end status"), r.where("id = 0"))
    assert sorted(x.id for x in gone.collect()) == sorted(i for i, _, d in rows if 0 in above(parent, i) and d != "a")


def test_cycles_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (4, 3, "d"), (5, 5, "e"), (None, 1, "x"), (6, None, None)], "id long, parent_id long, dir string")
    assert {x.id: x.root for x in graphs.tops(df.where("id is not null")).collect()} == {i: i for i in range(1, 7)}
    r = spark.createDataFrame([(2,)], "id long")
    assert sorted(x.id for x in graphs.subtree(df, r).collect()) == [1, 2, 3, 4]
    got = {x.id: x["values"] for x in graphs.below(df, "dir").collect()}
    assert got == {1: list("abcd"), 2: list("abcd"), 3: list("abcd"), 4: ["d"], 5: ["e"], 6: []}
    for f in (lambda d: graphs.subtree(d, r.limit(0)), graphs.tops, lambda d: graphs.below(d, "dir"), graphs.climbed):
        assert f(df.limit(0)).count() == 0
    assert sorted(map(tuple, graphs.subtree(df.limit(0), r).collect())) == [(2, 2)]


def test_reached_like_a_walk(spark):
    rng = random.Random(4)
    edges = [(k, rng.randrange(20), rng.randrange(20)) for k in (1, 2) for _ in range(24)] + [(1, None, 3), (2, 3, None), (1, 0, 1), (1, 0, 1)]
    starts = [(1, 0), (1, 5), (2, 7), (2, None), (2, 99)]
    want = set()
    for k, n in starts:
        todo = [(k, n)] if n is not None else []
        while todo:
            x = todo.pop()
            if x not in want:
                want.add(x)
                todo += [(x[0], d) for q, s, d in edges if (q, s) == x and d is not None]
    e, s = spark.createDataFrame(edges, "pipeline int, src int, dst int"), spark.createDataFrame(starts, "pipeline int, node int")
    assert sorted(map(tuple, graphs.reached(e, s, ("pipeline",)).collect())) == sorted(want)
    assert graphs.reached(e, s.limit(0), ("pipeline",)).count() == 0 and graphs.reached(e.limit(0), s, ("pipeline",)).count() == 4


def test_paths_are_doubled_from_the_longest_ones_in_small_tasks(spark, monkeypatch):
    """Before, every round joined and grouped all paths with all, in as few tasks as the shuffle gave."""
    from veilframe.operators import graphs

    monkeypatch.setattr(graphs, "ROWS", 20)
    rng = random.Random(4)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(17)} | {(k, k + 1) for k in range(20, 30)} | {(29, 25)} | {(k, 50) for k in range(51, 80)} | {(50, 49)}
    ahead: dict = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    want = set()
    for a in ahead:
        near, seen, n = ahead[a], set(), 1
        while near - seen:
            want |= {(a, b, n) for b in near - seen}
            seen, near, n = seen | near, {c for b in near - seen for c in ahead.get(b, ())}, n + 1
    got = graphs.closure(spark.createDataFrame([*edges, (None, 3)], "src int, dst int"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(got.inputFiles()) >= len(want) // 20
