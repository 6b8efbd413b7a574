"""Language identification: n-grams and filters beside plain versions, held-out accuracy, and odd texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import langid, queries

DATA = "/root/testdata/sf0.01"


def plain_ngrams(t):
    """(n-gram) of every word in blanks: no blank inside, not blanks alone."""
    words = "".join(c.lower() if c.isalpha() else " " for c in t or "").split()
    return Counter(w[i : i + n] for w in (f" {w} " for w in words) for n in langid.ORDERS for i in range(len(w) - n + 1))


def unpacked(g):
    return "".join(chr(g >> s & 0xFFFF) for s in (0, 16, 32, 48) if g >> s & 0xFFFF)


TEXTS = ["", None, " ", "a", "I am, here!", "Ünd  so\tweiter 123x", "x\0y", "été\n\nÀ la　carte", "9 . _ 8", "word " * 30, "日本語 テキスト"]


def test_ngrams_like_plain():
    got = defaultdict(Counter)
    for g, doc in langid.ngrams(TEXTS):
        assert (np.diff(doc) >= 0).all()
        for x, d in zip(g.tolist(), doc.tolist()):
            got[d][unpacked(x)] += 1
    assert [got[i] for i in range(len(TEXTS))] == [plain_ngrams(t) for t in TEXTS]
    assert [len(g) for g, _ in langid.ngrams([])] == [0, 0, 0]


def test_cut_keeps_ngrams():
    t = "eins zwei " * 400 + "x" * 3000 + " drei,vier" * 100
    whole, cut = Counter(), Counter()
    for g, _ in langid.ngrams([t, "fünf", t]):
        whole.update(g.tolist())
    for some in langid.cut([t, "fünf", t], 500):
        for g, _ in langid.ngrams([x for x, _ in some]):
            cut.update(g.tolist())
    assert whole == cut


def test_filters_like_plain_sets(spark):
    """Every kept n-gram's mask holds its languages; others show no more than the promised false positives."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("lang", "text").collect()
    n = defaultdict(Counter)
    for r in rows:
        n[r.lang].update(plain_ngrams(r.text))
    share = {}
    for lang, own in n.items():
        totals = Counter()
        for g, c in own.items():
            totals[len(g)] += c
        share[lang] = {g: c / totals[len(g)] for g, c in own.items() if c / totals[len(g)] >= langid.SHARE}
    most = Counter()
    for own in share.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    f = langid.fit(docs)
    assert f.langs == sorted(n, key=lambda x: (-sum(n[x].values()), x))
    kept = {lang: {g for g, x in own.items() if x >= langid.KEPT * most[g]} for lang, own in share.items()}
    some = sorted(set().union(*n.values()))
    packed = np.array([sum(ord(c) << 16 * i for i, c in enumerate(g)) for g in some], np.uint64)
    masks = f.masks(packed)[:, 0].tolist()
    for i, lang in enumerate(f.langs):
        wrong = [g for g, m in zip(some, masks) if (m >> i & 1) != (g in kept[lang])]
        assert not kept[lang] & set(wrong) and len(wrong) <= 0.008 * len(some)


def test_held_out_accuracy(spark):
    got = queries.op13_language_id(spark, DATA)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    x = got.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(x) == 1000 and x.score.between(0, 1).all()
    assert (x.lang == x.lang_pred)[x.held_out].mean() > 0.98


def test_odd_tables(spark):
    docs = [(1, "the house and the tree", "en"), (2, "das haus und der baum", "de"), (3, None, "fr"), (4, "le train", None), (5, "the house", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    f = langid.fit(df)
    assert f.langs == ["en", "de"]
    probe = [(1, "the tree"), (1, "the tree"), (2, "Haus, Baum!"), (3, None), (4, ""), (5, "12 .. 3"), (None, "日本"), (6, "und 7 " * 400_000)]
    odd = spark.createDataFrame(probe, "doc_id long, text string").selectExpr("*", "7 as score", "'x' as lang_pred", "'y' as lang")
    got = langid.predict(odd, f).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in got) == [(0, "en", False), (1, "en", True), (1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (6, "de", True)]
    assert langid.predict(odd.limit(0), f).count() == 0
    none = langid.fit(df.limit(0))
    assert none.langs == [] and {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_more_than_64_languages(spark):
    rng = random.Random(2)
    stems = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(8)] for i in range(70)}
    docs = [(" ".join(rng.choices(ws, k=60)), lang) for lang, ws in stems.items()]
    f = langid.fit(spark.createDataFrame(docs, "text string, lang string"), rows=1 << 14)
    assert f.table.shape == (1 << 14, 2)
    probe = spark.createDataFrame([(" ".join(rng.choices(ws, k=6)), lang) for lang, ws in stems.items()], "text string, lang string")
    assert langid.predict(probe, f).where(F.col("lang") != F.col("lang_pred")).count() == 0


def test_false_positives_are_taken_off():
    """A filter that is too small: the counts alone would favour the fuller language, the corrected ones don't."""
    rng = np.random.default_rng(5)
    table = (rng.random((4096, 1)) < 0.93).astype(np.uint64)  # the first language fills nearly every row
    grams = np.concatenate([g for g, _ in langid.ngrams(["zwei kleine woerter"])])
    for k in range(langid.HASHES):
        table[langid.rows_of(grams, k, 4096)] |= np.uint64(2)
    f = langid.Filters(["full", "true"], table)
    assert f.false[0] == pytest.approx(0.8, abs=0.05)
    lang, score = f.decide(["zwei kleine woerter", "kleine"])
    assert lang == ["true", "true"] and score[0] > 0.9
