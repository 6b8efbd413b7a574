"""The distributed model against the same formulas in plain Python."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.llm import katz


def brute(rows):
    words = {i: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for i, t, _ in rows}
    uni, two = Counter(), Counter()
    for i, _, train in rows:
        if train:
            uni.update(words[i])
            two.update(zip(["<s>"] + words[i][:-1], words[i]))
    d1 = katz.discounts(Counter(uni.values()))
    d2 = katz.discounts(Counter(two.values()))
    less = lambda c, d: d[c - 1] * c if c <= len(d) else c - 0.5
    n = sum(uni.values())
    p1 = {w: less(c, d1) / n for w, c in uni.items()}
    p1[None] = 1 - sum(p1.values()) if n else 1.0
    hist = {}
    for (h, w), c in two.items():
        hist.setdefault(h, {})[w] = c

    def prob(h, w):
        w = w if w in uni else None
        if h not in hist:
            return p1[w]
        seen, total = hist[h], sum(hist[h].values())
        if w in seen:
            return less(seen[w], d2) / total
        return (1 - sum(less(c, d2) for c in seen.values()) / total) / (1 - sum(p1[x] for x in seen)) * p1[w]

    for h in hist:
        assert math.isclose(sum(prob(h, w) for w in [*uni, None]), 1, abs_tol=1e-9)
    out = {}
    for i, _, _ in rows:
        h = ["<s>"] + words[i][:-1]
        out[i] = (len(words[i]), sum(w in uni for w in words[i]), n, sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in words[i]), sum(math.log10(prob(a, b)) for a, b in zip(h, words[i])))
    return out


@pytest.mark.parametrize("part_bytes", [10**9, 300])
def test_like_brute_force(spark, part_bytes, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "Ünder", "ÉTÉ", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choices(vocabulary, [40, 20, 10, 3, 3] + [1] * 60, k=rng.randrange(0, 60))), zlib.crc32(str(i).encode()) % 7 != 2) for i in range(150)]
    rows += [(200, None, True), (201, "", True), (202, "The OF\tthe\n\x0bof  unheard OF words " * 40, False), (203, "x" * 5000, True), (204, "the of " * 900, True)]
    monkeypatch.setattr(katz, "HOT", 0.01)
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    got = {r.doc_id: r[1:] for r in katz.score_texts(df, F.col("train"), part_bytes=part_bytes).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:3] == w[:3]
        assert got[i][3:] == pytest.approx(w[3:], rel=1e-9)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_texts(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in katz.score_texts(one, F.lit(False)).collect()}
    assert got == {1: (3, 0, 0.0), None: (2, 0, 0.0)}


def brute_any(rows, n):
    """The recursion of any order, one token after the other."""
    words = {i: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for i, t, _ in rows}
    padded = {i: ["<s>"] * (n - 1) + w for i, w in words.items()}
    grams = [None] + [Counter() for _ in range(n)]
    for i, _, train in rows:
        for k in range(1, n + 1) if train else ():
            for j in range(n - 1, len(padded[i])):
                grams[k][tuple(padded[i][j - k + 1 : j + 1])] += 1
    disc = [None, *(katz.discounts(Counter(g.values())) for g in grams[1:])]
    less = lambda c, k: disc[k][c - 1] * c if c <= len(disc[k]) else c - 0.5
    total = sum(grams[1].values())
    p1 = {w: less(c, 1) / total for (w,), c in grams[1].items()}
    unknown = 1 - sum(p1.values()) if total else 1.0
    after: dict = {}
    for k in range(2, n + 1):
        for g, c in grams[k].items():
            after.setdefault(g[:-1], {})[g[-1]] = c

    def prob(h, w):
        if not h:
            return p1.get(w, unknown)
        if h not in after:
            return prob(h[1:], w)
        seen, k = after[h], len(h) + 1
        if w in seen:
            return less(seen[w], k) / sum(seen.values())
        return (1 - sum(less(c, k) for c in seen.values()) / sum(seen.values())) / (1 - sum(prob(h[1:], x) for x in seen)) * prob(h[1:], w)

    return {i: sum(math.log10(prob(tuple(p[j - n + 1 : j]), p[j])) for j in range(n - 1, len(p))) for i, p in padded.items()}


@pytest.mark.parametrize(("order", "words", "part_bytes", "hot"), [(1, 5, 400, 0.01), (2, 5, 400, 0.01), (2, 10**6, 10**9, 1e-5), (3, 10**6, 10**9, 1e-5), (3, 5, 400, 0.01), (3, 30, 2000, 0.002), (4, 12, 600, 0.01)])
def test_any_order_like_brute_force(spark, order, words, part_bytes, hot, monkeypatch):
    """A small dictionary and many small parts: frequent words are spread, most others travel as digests."""
    import random

    rng = random.Random(order)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(40))]
    rows = [(i, " ".join(rng.choices(vocabulary, [40, 20, 10] + [1] * 40, k=rng.randrange(0, 60))), zlib.crc32(str(i).encode()) % 7 != 2) for i in range(120)]
    rows += [(200, None, True), (202, "The OF\tthe\n\x0bof  unheard OF words " * 20, False), (203, "the of " * 400, True), (204, "new", False), (205, "once w1 w1 once", True)]
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "DICT", words)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    got = {r.doc_id: r.score for r in katz.score_texts(df, F.col("train"), order=order, part_bytes=part_bytes).collect()}
    assert got == pytest.approx(brute_any(rows, order), rel=1e-9)


def test_rows_of_one_id_are_scored_apart(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b c"), (None, "c"), (None, None)], "doc_id long, text string")
    got = katz.score_texts(rows.withColumn("__text", F.lit(0)).withColumn("n_tokens", F.lit(7)), F.lit(True), order=3).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 4)]
