"""Language identification: n-grams of letters in bit-sliced Bloom filters that answer for all languages at once.

A row of the filter is a mask with a bit for each language. An n-gram sets its languages' bits in HASHES rows; the AND of
these rows is the mask of all languages that may contain it. A text's n-grams are looked up once, the bits are counted for
each language, and each count is corrected for the share of false positives that the filling of that language's bits gives.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import map_text, parts, runs, stored

#: n-grams of 2, 3 and 4 letters of a word, the blanks at its ends included.
ORDERS = (2, 3, 4)
#: A language contains an n-gram that is this share of its n-grams of that order (so at most 1 / SHARE of each order),
#: and at least KEPT times as large a share as in the language where it is most frequent.
SHARE, KEPT = 2e-5, 0.3
#: Rows of the filter and rows an n-gram sets: with at most 3 / SHARE n-grams a language, fewer than 0.8 % are false positives.
ROWS, HASHES = 1 << 21, 3
UNKNOWN = "und"
#: A task hands its counts on once it holds so many different n-grams.
HELD = 1_000_000
NO_LETTER = re.compile(r"[\W\d_]")
BLANK, GAP = np.uint64(32), np.uint64(0)
STEP, MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@cache
def _letters() -> np.ndarray:
    """The 16-bit letter of every code point: lower-cased, folded into 16 bits beyond them; 32 if it is no letter."""
    out = np.full(0x110000, 32, np.uint16)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else (c & 0x7FFF) | 0x8000
    return out


def letters_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, a gap and a blank before each text and a blank after it, and the length of each text there."""
    data = "".join(["\0 " + (t or "") + " " for t in texts]).encode("utf-32-le", "surrogatepass")
    cps = np.frombuffer(data, np.uint32)
    a = _letters()[cps].astype(np.uint64)
    sizes = np.array([len(t or "") + 3 for t in texts], np.int64)
    a[np.cumsum(sizes) - sizes] = GAP
    return a, sizes


def cut(texts: list, size: int = 1 << 19):
    """Runs of (text, its number) of about `size` letters together; longer texts in pieces that end behind a non-letter."""
    own, held = [], 0
    for i, t in enumerate(texts):
        t, a = t or "", 0
        while len(t) - a > size and (m := NO_LETTER.search(t, a + size)):
            yield [(t[a : m.end()], i)]
            a = m.end()
        own.append((t[a:], i))
        held += len(t) - a
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


def ngrams(texts: list):
    """Of each order all n-grams of the texts, as numbers of up to four letters, and the numbers of their texts, rising."""
    a, sizes = letters_of(texts)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != BLANK) | (a[:-1] != BLANK)  # blanks in a row count as one
    doc = np.repeat(np.arange(len(texts)), sizes)[keep]
    a = a[keep]
    letter, inside = a > BLANK, a != GAP
    key, inner = a, np.ones(len(a), bool)
    for n in range(2, max(ORDERS) + 1):
        # between its ends an n-gram has letters alone
        key = key[:-1] | (a[n - 1 :] << np.uint64(16 * (n - 1)))
        inner = inner[:-1] & letter[n - 2 : len(a) - 1] if n > 2 else inner[:-1]
        ok = inner & inside[: len(key)] & inside[n - 1 :]
        if n == 2:
            ok &= letter[:-1] | letter[1:]
        if n in ORDERS:
            yield key[ok], doc[: len(key)][ok]


def rows_of(grams: np.ndarray, k: int, rows: int) -> np.ndarray:
    """The k-th row of each n-gram."""
    x = grams + np.uint64(STEP * (k + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return ((x ^ (x >> np.uint64(31))) % np.uint64(rows)).astype(np.int64)


def count_ngrams(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n over all rows with a language. Tasks add up n-grams before they shuffle."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        held: dict[str, list] = {}

        def merged(own):
            g = np.concatenate([x for x, _ in own])
            order = np.argsort(g)
            g = g[order]
            n = np.concatenate([x for _, x in own])[order]
            at = runs(g) if len(g) else np.empty(0, np.int64)
            return g[at], np.add.reduceat(n, at) if len(at) else n

        def flush():
            for name, own in held.items():
                g, n = merged(own)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=schema.names)
            held.clear()

        for b in (p for batch in batches for p in parts(batch, "text")):
            names, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for name in sorted(set(names)):
                own = held.setdefault(name, [])
                for some in cut([t for t, x in zip(texts, names) if x == name]):
                    own += [np.unique(g, return_counts=True) for g, _ in ngrams([t for t, _ in some])]
                    if len(own) > 24:
                        own[:] = [merged(own)]
            if sum(len(g) for own in held.values() for g, _ in own) > HELD:
                yield from flush()
        yield from flush()

    d = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return d.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Languages in order, the filter's rows (one column of 64 languages after the other) and the filling of each language's bits."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self.false = np.array([float((table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) ** HASHES for i in range(len(langs))])

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the masks of the languages that may contain it."""
        out = self.table[rows_of(grams, 0, len(self.table))]
        for k in range(1, HASHES):
            out &= self.table[rows_of(grams, k, len(self.table))]
        return out

    def decide(self, texts: list) -> tuple[list, list]:
        """Language and score (the corrected share of its n-grams that the language contains) of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, hits = np.zeros(len(texts)), np.zeros((len(self.langs), len(texts)))
        for some in cut(texts):
            who = np.array([i for _, i in some])
            for grams, doc in ngrams([t for t, _ in some]):
                if not len(grams):
                    continue
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                own = who[doc[starts]]
                total[own] += np.diff(starts, append=len(doc))
                masks = self.masks(grams)
                for i in range(len(self.langs)):
                    hits[i, own] += np.add.reduceat((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), starts)
        true = np.maximum(hits - total * self.false[:, None], 0) / np.maximum(1 - self.false[:, None], 1e-9)
        score = (true.max(0) / np.maximum(total, 1)).clip(0, 1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(true.argmax(0), total)], score.tolist()


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", rows: int = ROWS) -> Filters:
    """Learn every language's n-grams from all rows with a text and a language (an empty table teaches no language).

    Counts of all texts are made and compared on the cluster. The driver gets the languages, with a total for each, and
    the filter: `rows` masks at most, however large the corpus is (8 bytes each for 64 languages).
    """
    order = F.when(F.shiftrightunsigned("gram", 48) > 0, 4).when(F.shiftrightunsigned("gram", 32) > 0, 3).otherwise(2)
    counts = stored(count_ngrams(docs, text=text, lang=lang).withColumn("order", order))
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    langs = [r.lang for r in totals.groupBy("lang").agg(F.sum("total").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    table = np.zeros((rows, (len(langs) + 63) // 64), np.uint64)
    if not langs:
        return Filters(langs, table)
    number = docs.sparkSession.createDataFrame([(name, i) for i, name in enumerate(langs)], "lang string, number int")
    share = F.col("n") / F.col("total")
    grams = counts.join(totals.join(number, "lang"), ["lang", "order"]).select("gram", "number", share.alias("share")).where(F.col("share") >= SHARE)
    grams = grams.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("number", "share")).alias("of"))
    grams = grams.select("gram", F.explode(F.expr(f"filter(of, x -> x.share >= {KEPT} * most)")).alias("x"))
    bits = F.bit_or(F.expr("shiftleft(1L, x.number % 64)")).alias("mask")
    grams = grams.groupBy("gram", F.expr("x.number div 64").cast("int").alias("word")).agg(bits)

    def spread(batches):
        for b in batches:
            g, word, mask = (b.column(n) for n in ("gram", "word", "mask"))
            for k in range(HASHES):
                at = rows_of(g.to_numpy().view(np.uint64), k, rows)
                yield pa.RecordBatch.from_arrays([pa.array(at), word, mask], names=["row", "word", "mask"])

    got = grams.mapInArrow(spread, "row long, word int, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[got["row"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Filters(langs, table)


def predict(docs: DataFrame, filters: Filters, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1); columns that have these names already are replaced, keep: the others that stay.

    Null texts and texts without a letter are `und` with score 0, and so is everything where no language was learnt. Of
    languages with equal counts, and for letters that no language contains, the one with more text in training is taken.
    Rows are independent; one pass over whole texts, no shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(filters)
    return map_text(docs, text, "lang_pred string, score double", lambda: shipped.value.decide, keep)
