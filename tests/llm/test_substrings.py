"""Removed bytes and maximal repeats against plain searches."""

import hashlib
import random

import pytest

from veilframe.llm import substrings


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        out[i] = (sum(gone), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "of", "é", "straße", "and", *(f"w{i}x" for i in range(50))]
    text = lambda n: " ".join(rng.choices(words, k=n))
    long, passage = text(200), text(30)
    rows = [(i, text(rng.randrange(1, 150))) for i in range(20)]
    rows += [(20 + i, long) for i in range(3)] + [(30 + i, text(20) + passage + text(20)) for i in range(8)]
    for i in range(8):
        k = rng.randrange(len(long))
        rows.append((50 + i, long[:k] + "#" + long[k + rng.randrange(5) :]))
    rows += [(70, None), (71, ""), (72, "ab" * 900), (73, "a" * 99), (74, "a" * 100), (75, "a" * 101), (76, passage + passage + "!" + passage)]
    rng.shuffle(rows)
    return rows


def test_like_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(substrings, "PART_ANCHORS", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (sum(x.end - x.start for x in r.removed), bytes(r.kept)) for r in substrings.remove_repeats(df).collect()}
    assert got == brute(rows)


def test_pieces_and_hot_cells_change_nothing(monkeypatch):
    import numpy as np

    t = random.Random(1).randbytes(3000)
    texts = [t, b"short", t[:500], b""]
    whole = [np.concatenate(x) for x in zip(*substrings.anchors(texts, 100, None))]
    monkeypatch.setattr(substrings, "PIECE", 700)
    parts = list(substrings.anchors(texts, 100, None))
    spread = lambda found: [(int(d), int(i), w) for x, t, f, n in found for d, i, a, k in zip(x, t, f, n) for w in range(a, a + k)]
    assert spread(parts) == spread([whole])


def test_intervals():
    assert sorted(substrings.intervals([3, 5, 3, 0, 2], 2)) == [(2, 4, 5), (3, 0, 3), (5, 1, 2)]


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(4)
    core = bytes(rng.choices(b"abc", k=30))
    rows = [(i, 7, 12, bytes([65 + i]) + core[: 20 + i] + bytes([75 + i]) * (11 - i)) for i in range(4)]
    got = {(size, tuple(sorted(zip(ids.tolist(), starts.tolist())))) for size, ids, starts in substrings.maximal_repeats(rows, 20)}
    assert (20, tuple((i, 7) for i in range(4))) in got
    assert (22, ((2, 7), (3, 7))) in got


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).count() == 0
    odd = spark.createDataFrame([(1, "z" * 150, b"old"), (1, "z" * 150, b""), (None, None, None)], "doc_id long, text string, kept binary")
    got = [(r.doc_id, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, hashlib.sha256(b"z").hexdigest()), (1, hashlib.sha256(b"z").hexdigest()), (None, hashlib.sha256(b"").hexdigest())], key=str)


def test_different_texts_of_one_id(spark):
    """Each row keeps what occurs nowhere before it; texts of one id come in the order of their digests."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, own = text(230), text(350)
    rows = [(1, passage), (1, passage[10:150] + own), (1, passage), (2, own), (2, text(120)), (0, text(90)), (None, own[:200]), (None, text(30)), (None, None)]
    order = sorted({(-1 if i is None else i, hashlib.sha256((t or "").encode()).hexdigest(), t) for i, t in rows}, key=lambda r: r[:2])
    want = dict(zip([r[::2] for r in order], brute([(k, t) for k, (*_, t) in enumerate(order)]).values()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as nth").repartition(3)
    got = substrings.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (sum(x.end - x.start for x in r.removed), bytes(r.kept)) == want[-1 if r.doc_id is None else r.doc_id, r.text]
        assert all(0 <= x.start < x.end <= len(r.text) for x in r.removed)
    texts = {(-1 if i is None else i, t) for i, t in rows if t}
    groups: dict = {}
    for g in substrings.repeat_groups(df).collect():
        mine = sorted((hashlib.sha256(t.encode()).hexdigest(), t) for i, t in texts if i == (-1 if g.id == -(2**63) else g.id))
        if g.id == -(2**63):  # the null text is one of that id's
            mine = sorted([*mine, (hashlib.sha256(b"").hexdigest(), "")])
        groups.setdefault(g.group, set()).add(mine[g.nth][1][g.start : g.end])
    assert groups and all(len(x) == 1 for x in groups.values())
