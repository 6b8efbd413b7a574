"""The registered queries' own columns on given texts, from plain readings of what they promise."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import queries

DATA = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()
low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_secrets(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    got = {r.doc_id: r for r in queries.op3_secrets(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3)) and r.base_sha256 == sha(told.encode())
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in told.split(",") if s]
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_repeated_bytes(spark, docs):
    got = {r.doc_id: r for r in queries.op4_substring_dedup(spark, DATA).collect()}
    seen = set()
    for i, t in sorted(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))


def test_similar_documents(spark, docs):
    sets, at = {}, defaultdict(list)
    for i, t in docs:
        ws = [w for w in re.split("[\x20\x09-\x0d]+", low(t)) if w]
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
        for s in sets[i]:
            at[s].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        for j, n in Counter(j for s in own for j in at[s] if j < i).items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, DATA).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(docs)


def test_base_scores_of_the_language_model(spark, docs):
    tokens = {i: [w for w in re.split("[\x20\x09-\x0d]+", low(t)) if w] + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op10_katz(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0


def test_toxicity_columns(spark, docs):
    rows = queries.op8_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    by = defaultdict(set)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        by[r.text].add(r.score)
    assert all(len(s) == 1 for s in by.values())  # the text alone decides
