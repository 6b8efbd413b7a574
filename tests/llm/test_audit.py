"""The filter interaction audit beside DuckDB and beside a plain walk over documents and orders."""

import random
import re
from itertools import permutations

from test_texts import compare_sql

from veilframe.llm import audit


def test_like_duckdb(spark):
    compare_sql(spark, "op11_filter_audit")


def plain(docs, labels):
    """Apply the filters one after the other to each document, in every order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, x in labels if i is not None and x == 1}
    first: dict = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        ws = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {f for f, yes in zip("ABCDE", (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), set(t) & set("#$%&*|"), i is not None and first[t] < i)) if yes}
        rows.append((i, lang or "", fails))
    out = {}
    for part in {p for _, p, _ in rows}:
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [(i, fails) for i, p, fails in rows if p == part]
            for k, f in enumerate(order):
                go = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [fails for _, p, fails in rows if p == part and f in fails]
                removed_of[f] += len(go)
                out[part, order, k + 1] = [len(left), len(go), len(failing) - len(go), sum(x == {f} for x in failing), sum(i in good for i, _ in go), sum(i in bad for i, _ in go)]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1].append(removed_of[f])
    return out


def test_like_a_plain_walk(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)] + ["ABC", "Ünd", "50%", "a\x1cb", "x\x0by"]
    texts = [None, "", " ", "A", "#", "one two"] + [" ".join(rng.choices(words[: rng.choice((20, 155))], k=rng.randrange(60, 180))) for _ in range(12)]
    docs = [(rng.randrange(40), rng.choice(texts), rng.choice(("en", "de", None, ""))) for _ in range(60)]
    docs += [docs[0]] * 3 + [(None, texts[6], "en"), (None, texts[6], "en"), (-1, texts[7], "de"), (50, "long " * 30000, "en"), (51, "LONG " * 30000, "en")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 40, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "'x' as part", "2 as mask", "'y' as id").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(df, lab).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == plain(docs, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})
    assert audit.filter_audit(df.limit(0), lab).count() == 0
    assert {r.good_lost for r in audit.filter_audit(df, lab.limit(0)).collect()} == {0}


def test_edges_of_the_lattice(spark):
    counts = spark.createDataFrame([("p", 0, True, False, 3), ("p", 31, False, True, 2)], "part string, mask int, good boolean, toxic boolean, n long")
    edges = audit.lattice_edges(counts, 5)
    assert edges.count() == 80
    steps = audit.order_steps(edges, "ABCDE").collect()
    assert len(steps) == 600 and all(r.kept == 3 and (r.removed, r.redundant) == ((2, 0) if r.step == 1 else (0, 2)) and r.shapley == 48 for r in steps)
