"""Toxicity: the bag of a text's character n-grams, averaged into a linear softmax, embeddings and softmax trained jointly.

Words share the vectors of their n-grams, so spellings that were never seen are scored by the pieces that were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import pack, small, unpack

BITS, NMIN, NMAX, DIM = 18, 3, 6, 4
#: At most so many labelled rows of each class are fitted on (the ones with the smallest digests of their text).
PER_CLASS = 2500
#: Only word bytes stay: a-z (A-Z folded), digits and bytes beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BYTE = np.random.default_rng(12345).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Texts are hashed in pieces of so many bytes, cut between words.
PIECE = 1 << 20


def _pieces(text: bytes):
    words = b" ".join(text.translate(FOLD).split())
    at = 0
    while at < len(words):
        cut = len(words) if len(words) - at <= PIECE else words.find(b" ", at + PIECE)
        cut = len(words) if cut < 0 else cut
        yield np.frombuffer(b" " + words[at:cut] + b" ", np.uint8)
        at = cut + 1


def buckets(text: bytes):
    """Arrays of the buckets of all n-grams of the words of a text, a blank standing for a word's ends."""
    for s in _pieces(text):
        blank = np.concatenate(([0], np.cumsum(s == 32)))
        t = BYTE[s]
        h = t.copy()
        for n in range(2, min(NMAX, len(s)) + 1):
            h = h[:-1] * STEP + t[n - 1 :]
            if n >= NMIN:
                inner = blank[n - 1 : len(s)] == blank[1 : len(s) - n + 2]  # no blank but at the ends
                g = h[inner]
                yield (((g ^ (g >> np.uint64(29))) * MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of the text's n-grams."""
    parts = list(buckets(text or b""))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


class PackedBags:
    """Bags kept packed (about 5 kB each) and unpacked when they are asked for."""

    def __init__(self, bodies: list[bytes]):
        self.bodies = bodies

    def __len__(self) -> int:
        return len(self.bodies)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        steps, n = unpack(self.bodies[i])
        return np.cumsum(steps, dtype=np.int64).astype(np.int32), (n / max(1, n.sum(dtype=np.int64))).astype(np.float32)


def pack_bag(text: bytes) -> bytes:
    """Steps between the text's buckets, and their counts."""
    parts = list(buckets(text))
    ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
    return pack(small(np.diff(ids, prepend=0)), small(n))


def train(bags, labels: np.ndarray, *, prior: float, epochs: int = 12, batch: int = 64, rate: float = 0.4, seed: int = 1):
    """Fit embeddings and softmax by AdaGrad; returns the per-bucket logit of class 1 against 0, and the bias.

    bags: (buckets, shares) of each row, by number.
    """
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32)
    out = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(1 << BITS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    rows = [i for i in range(len(bags)) if len(bags[i][0])]
    scale = np.float32(10.0)  # of the averages, which are small as most n-grams say nothing
    for _ in range(epochs):
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            own = rows[k : k + batch]
            got = [bags[i] for i in own]
            ids = np.concatenate([b[0] for b in got])
            val = np.concatenate([b[1] for b in got]) * scale
            at = np.concatenate(([0], np.cumsum([len(b[0]) for b in got])[:-1]))
            mean = np.add.reduceat(emb[ids] * val[:, None], at)
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            y = labels[own]
            d = p.copy()
            d[np.arange(len(own)), y] -= 1
            d *= (weight[y] / len(own))[:, None].astype(np.float32)
            d_mean = d @ out.T
            uniq, inv = np.unique(ids, return_inverse=True)
            rep = np.repeat(d_mean, np.diff(np.append(at, len(ids))), axis=0) * val[:, None]
            grad = np.stack([np.bincount(inv, rep[:, j], len(uniq)) for j in range(DIM)], 1).astype(np.float32)
            g_emb[uniq] += (grad**2).mean(1)
            emb[uniq] -= rate * grad / np.sqrt(g_emb[uniq])[:, None]
            grad = mean.T @ d
            g_out += grad**2
            out -= 0.1 * grad / np.sqrt(g_out)
            grad = d.sum(0)
            g_bias += grad**2
            bias -= 0.1 * grad / np.sqrt(g_bias)
    side = out[:, 1] - out[:, 0]
    shift = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    return (emb @ side * scale).astype(np.float32), float(bias[1] - bias[0] + shift)


def fit(labelled: DataFrame, *, text: str = "text", label: str = "label", per_class: int = PER_CLASS):
    """Train on (text, label 0/1) rows; at most per_class rows of each class, whole texts, chosen by md5 of the text.

    Texts are turned into bags in Spark tasks; one task gets the bags of the sample, packed (about 5 kB a row), and trains in
    numpy; the driver gets the model alone (1 MB). Rows with a null text or label are left out. The classes' shares among all rows set the bias. Without rows
    of both classes every score is the share of label 1 (0.5 without any rows).
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).cast("binary").alias("t"), F.col(label).cast("int").alias("y"))
    n = _classes(rows)
    if len(n) < 2:
        return _constant(n)
    key = F.conv(F.substring(F.md5("t"), 1, 12), 16, 10).cast("long")
    return _fit_sample(_below(rows.withColumn("key", key), n, per_class), n, per_class)


def fit_by_id(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "label", per_class: int = PER_CLASS):
    """fit() for texts and labels in two tables: the sample is chosen by digest of the id, before any text is moved.

    Ids and labels alone are joined; the ids of the sample (about 1.2 * per_class of each class) are broadcast to the
    texts. An id that occurs several times with one label counts once in the sample, with its smallest text. Rows with a null
    id, text or label are left out.
    """
    key = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2**48))
    ids = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), key.alias("key"))
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    rows = ids.join(marks, "id").distinct()
    n = _classes(rows)
    if len(n) < 2:
        return _constant(n)
    chosen = F.broadcast(_below(rows, n, per_class))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("t"))
    return _fit_sample(texts.join(chosen, "id").groupBy("key", "y").agg(F.min("t").alias("t")), n, per_class)


def _classes(rows: DataFrame) -> dict[int, int]:
    return {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}


def _constant(n: dict[int, int]):
    total = sum(n.values())
    share = n.get(1, 0) / total if total else 0.5
    return np.zeros(1 << BITS, np.float32), float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -14, 14))


def _below(rows: DataFrame, n: dict[int, int], per_class: int) -> DataFrame:
    """About 1.2 * per_class rows of each class by key (48 bits): the task that trains never sees more."""
    limit = F.lit(0).cast("long")
    for y, k in n.items():
        limit = F.when(F.col("y") == y, F.lit(int(2**48 * min(1.0, 1.2 * per_class / k)))).otherwise(limit)
    return rows.where(F.col("key") < limit)


def _fit_sample(near: DataFrame, n: dict[int, int], per_class: int):
    """Train on the per_class rows of each class with the smallest keys."""

    def bags(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                c = b.slice(a, 64)
                yield pa.RecordBatch.from_arrays([c.column("key"), c.column("y"), pa.array([pack_bag(t) for t in c.column("t").to_pylist()], pa.binary())], names=["key", "y", "body"])

    def fitted(batches):
        got = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: r[:2])
        left, rows = {0: per_class, 1: per_class}, []
        for r in got:
            if left[r[1]] > 0:
                left[r[1]] -= 1
                rows.append(r)
        del got
        weights, bias = train(PackedBags([r[2] for r in rows]), np.array([r[1] for r in rows], np.int64), prior=prior)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    prior = n.get(1, 0) / sum(n.values())
    packed = near.select("key", "y", "t").mapInArrow(bags, "key long, y int, body binary")
    model = packed.repartition(1).mapInArrow(fitted, "weights binary, bias double").first()
    return np.frombuffer(bytes(model.weights), np.float32), model.bias


def score(df: DataFrame, model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out`, the probability of label 1 (0 to 1): the softmax of the mean of the text's n-gram vectors.

    The model is one number for each of 2^18 buckets (1 MB, broadcast). Whole texts are read, in pieces of 1 MB.
    Null and empty texts have no n-grams and get the bias alone. Repeated rows get equal scores; empty tables stay empty.
    """
    weights, bias = model
    shipped = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shipped.value
        for b in batches:
            scores = []
            for t in b.column("__text").to_pylist():
                total, n = 0.0, 0
                for ids in buckets(t or b""):
                    total += float(w[ids].sum(dtype=np.float64))
                    n += len(ids)
                scores.append(1 / (1 + np.exp(-np.clip(bias + (total / n if n else 0), -30, 30))))
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()) if c == out else b.column(i) for i, c in enumerate(b.schema.names)], names=b.schema.names)

    d = df.drop(out).withColumn("__text", F.col(text).cast("binary")).withColumn(out, F.lit(0.0))
    return d.mapInArrow(run, d.schema).drop("__text")
