"""Spelling variants beside a plain version that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from veilframe.llm import queries, spelling


def one_edit(a: str, b: str) -> bool:
    some = [a[:i] + a[i + 1 :] for i in range(len(a))], [b[:i] + b[i + 1 :] for i in range(len(b))]
    replaced = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    return a != b and (replaced or a in some[1] or b in some[0])


def plain(docs, least=5, close=one_edit):
    n: Counter = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode("utf-8"))
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    out = {}
    for w in n:
        some = [x for x in n if abs(len(x) - len(w)) < 2 and close(w, x)]
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = [n[w], form, n.get(form), len(some)]
    for w in out:
        root = w
        while out[root][1]:
            root = out[root][1]
        out[w] = (*out[w], root)
    return out


def found(df):
    return {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect()}


@pytest.mark.parametrize("shard, half", [(40_000, 20_000), (60, 3)])
def test_like_brute_force(spark, monkeypatch, shard, half):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "HALF_WORDS", half)
    rng = random.Random(7)
    stems = ["".join(rng.choices("abñé", k=rng.randrange(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "bbbbbb", "abababab", "ÀÉabcd×"]
    words = [(w, 1.9**-k) for s in stems for k, w in enumerate([s, s[:2] + "x" + s[2:], s[1:], s[:3] + "ñ" + s[4:], s + "a", s[:3] + s[4:]])]
    docs = [(i, " ".join(rng.choices([w for w, _ in words], [p for _, p in words], k=400))) for i in range(30)]
    docs += [(100, "chained " * 5 + "chainex " * 30 + "chainxx " * 160), (None, "Aaaaaaa bbbbbb"), (3, None), (4, ""), docs[0], docs[0], (5, "aaaaaa" * 300_000), (6, "abababab, 7" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as id").repartition(4)
    got, want = found(spelling.variant_groups(df)), plain(docs)
    assert got == want and sum(x[1] is not None for x in want.values()) > 5
    assert any(want[x[1]][1] for x in want.values() if x[1])
    assert spelling.variant_groups(df.limit(0)).count() == 0
    assert spelling.variant_groups(df.where("text = ''")).count() == 0


def test_query_on_given_texts(spark):
    data = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op12_spelling_variants(spark, data)) == plain(docs)


def test_pieces_do_not_part_words():
    text = ("éàü word " * 50 + "longword" * 40).encode()
    cut = list(spelling.pieces(text, 30))
    assert b"".join(cut) == text and len(cut) > 5
    assert [w for c in cut for w in re.findall("[a-zà-ÿ]+", c.decode())] == re.findall("[a-zà-ÿ]+", text.decode())
