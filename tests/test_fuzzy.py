"""Fuzzy matching of all names against brute force, with broadcasts and without."""

import random

import pytest

from veilframe.operators import texts
from veilframe.plans import queries as plans


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return round(200.0 * row[-1] / (len(a) + len(b))) if a and b else 0


@pytest.fixture(params=["-1", "10MB"])
def broadcast(spark, request):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_all_names_like_brute_force(spark, tmp_path, broadcast):
    rng = random.Random(3)
    names = ["".join(rng.choices("abc ", k=rng.randrange(1, 14))) for _ in range(70)] + ["", None, "late name", "late names"]
    rows = [(k + 1, n) for k, n in enumerate(names + names[:9])]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    known = {n for n in names if n}
    want = {(a, b, ratio(a, b)) for a in known for b in known if ratio(a, b) > 70}
    got = [tuple(r) for r in plans.QUERIES["fuzz_ratio_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and ("late name", "late names", 95) in want
    first = {a: min((b, r) for x, b, r in want if x == a) for a in known}
    got = {r.text: (r.phrase, r.ratio) for r in plans.QUERIES["t2a_fuzzy_phrases_all"](spark, str(tmp_path)).collect()}
    assert got == first


@pytest.mark.parametrize("threshold", [0, 37, 69, 70, 90, 100])
def test_thresholds_and_letters_of_all_kinds(spark, threshold):
    rng = random.Random(threshold)
    some = ["".join(rng.choices("aab1\u00e9\U0001f600 .", k=rng.randrange(1, 12))) for _ in range(60)] + ["x" * 90, "x" * 70 + "y", "1", "11", "a1"]
    rows = [(i, p) for i, p in enumerate([*rng.sample(some, 20), *some[-5:], some[0], some[0], "", None])]
    got = sorted(tuple(r) for r in texts.similar(spark.createDataFrame([(t,) for t in [*some, *some, "", None]], "text string"), spark.createDataFrame(rows, "ord int, phrase string"), threshold).collect())
    assert got == sorted((t, i, p, ratio(t, p)) for t in set(some) for i, p in rows if p and ratio(t, p) > threshold)


def test_few_pairs_are_compared_in_full(spark):
    """Of names of several words at most ten times as many pairs pass the shared letters as are similar."""
    rng = random.Random(5)
    colours, things = ["red", "blue", "green", "small", "large", "late"], ["bolt", "gear", "anvil", "gizmo", "widget", "spring", "valve"]
    names = sorted({f"{a} {b}" for a in colours for b in rng.sample(things, 5)})
    df = spark.createDataFrame([(n,) for n in names], "text string")
    bags = {n: {c + str(n[:i].count(c)) for i, c in enumerate(n)} for n in names}
    compared = sum(400 * len(bags[a] & bags[b]) >= 141 * (len(a) + len(b)) for a in names for b in names)
    assert compared <= 10 * texts.similar(df, df.withColumnRenamed("text", "phrase")).count()
