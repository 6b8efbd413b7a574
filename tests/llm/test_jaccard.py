"""The join against all pairs in plain Python."""

import random
import re

import pytest

from veilframe.llm import jaccard


def shingle_set(t, width=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, threshold=75):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("small", [8, 2])
def test_like_all_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "TRIE", 4)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(30)]
    for base in range(3):
        text = rng.choices(words, k=70)
        for _ in range(20):
            copy = list(text)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    line = " ".join(rng.choices(words, k=40))
    rows += [(len(rows) + k, line + " " + " ".join(rng.choices(words, k=30))) for k in range(12)]
    rows += [(500, None), (501, ""), (502, "  \n"), (503, "One two"), (504, "ONE two"), (505, "x " * 3000), (506, "x " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c", 1), (3, "a b c", 2), (3, "A B C", 3), (4, None, 4)], "doc_id long, text string, cls long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.similar_documents(odd).collect())
    assert got == [(0, 1, 3), (3, 1, 3), (3, 1, 3), (4, 0, 4)]


def test_trie_shares_and_prunes():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 200, 150)) for _ in range(60)]
    for probe in sets[:10]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 40 * len(np.union1d(probe, s))]
        assert sorted(jaccard.trie_links(probe, list(enumerate(sets)), lambda s: s.astype(">i8"), 40)) == want


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text, too different for many of their pairs to be links, among other texts that share its rare words."""
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "PART_BYTES", 5000)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    text = rng.choices(words, k=60)
    rows = []
    for i in range(90):
        copy = list(text)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(text[:20] + rng.choices(words, k=25))) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == brute(rows)
