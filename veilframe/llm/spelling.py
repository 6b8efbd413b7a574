"""Spelling variants: words of a corpus grouped with the much more frequent words that differ by one code point.

If two words differ by one inserted, deleted or replaced code point, at least one half of the first word stands unharmed
at its end of the second one. So every word puts both of its halves into an Aho-Corasick automaton, and every word is
scanned for halves; a half found at the wrong offset, or of a word whose length differs by more than one, is no match,
and the others are verified.

The halves are dealt out over many automata (shards) by digest. A word is sent to the shards of the prefixes and suffixes
that may be halves of words one shorter, equally long or one longer: four at most. Halves that very many words share are
spread over several shards, and the words that may hold them are sent to each. Within a shard, the words that own a half
are looked up by what is left of them with one code point deleted, so that a half costs as many steps as it has words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import parts, stored

#: Maximal runs of these letters are words; shorter runs can't become words and are not looked at.
LETTERS = "A-Za-zÀ-ÿ"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Every occurrence of a run in a document has a digest; where this number divides it, one code point is deleted.
NOISE = 199
#: Words held by one automaton, and words that one half may bring into one (more are spread).
SHARD_WORDS, HALF_WORDS = 40_000, 20_000
#: A task hands its counts on once it holds so many words; texts are cut between words into pieces of so many bytes.
HELD, PIECE = 200_000, 1 << 20


def damaged(run: str, seed: int) -> str:
    """The run as it counts in a document: seed is the digest of the document's id and a colon."""
    h = zlib.crc32(run.encode(), seed)
    if h % NOISE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def pieces(text: bytes, size: int = PIECE):
    """Cut a text after about `size` bytes each, at an ASCII byte that is no letter (where there is one)."""
    a = 0
    while len(text) - a > size:
        m = re.compile(rb"[^A-Za-z\x80-\xff]").search(text, a + size)
        if not m:
            break
        yield text[a : m.end()]
        a = m.end()
    yield text[a:]


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n: lower-cased (A-Z only) runs of letters after the deletions above, of `shortest` code points and `least` occurrences.

    Null texts have no words; a null id counts as an empty string; repeated rows count each. Tasks add up before they shuffle.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    find = re.compile(f"[{LETTERS}]{{{shortest},}}").findall

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=schema.names)
            held.clear()
            return out

        for b in (p for batch in batches for p in parts(batch, "text")):
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for piece in pieces((t or "").encode().translate(FOLD)):
                    for w, n in Counter(find(piece.decode())).items():
                        w = damaged(w, seed)
                        if len(w) >= shortest:
                            held[w] += n
                    if len(held) >= HELD:
                        yield flush()
        yield flush()

    counts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def halves(word: str) -> tuple[str, str]:
    k = len(word) // 2
    return word[:k], word[k:]


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Shard:
    """An automaton of halves. A half's key: whether it is the second one, then the half.

    owners: for each half the rests of its words (what the half leaves), as they are and with one code point deleted,
    and the words with such a rest.
    """

    def __init__(self, keys: list[str], words: list[str]):
        import ahocorasick

        self.owners: dict = {}
        for key, w in zip(keys, words):
            at = self.owners.setdefault(key, {})
            for v in variants(rest(key, w)):
                at.setdefault(v, []).append(w)
        self.automaton = ahocorasick.Automaton()
        for half in {k[1:] for k in self.owners}:
            self.automaton.add_word(half, half)
        if self.owners:
            self.automaton.make_automaton()

    def partners(self, word: str) -> set[str]:
        """Words that own a half which stands at its end of this word, and are near it."""
        found = set()
        if not self.owners:
            return found
        for end, half in self.automaton.iter(word):
            for second in (False, True):
                if end + 1 != (len(word) if second else len(half)):
                    continue
                key = f"{second:d}{half}"
                at = self.owners.get(key)
                for v in variants(rest(key, word)) if at else ():
                    for w in at.get(v, ()):
                        if w not in found and near(w, word) and not (second and word.startswith(halves(w)[0])):  # then its first half tells
                            found.add(w)
        return found


def rest(key: str, word: str) -> str:
    """What of a word a half leaves."""
    return word[: len(word) - len(key) + 1] if key[0] == "1" else word[len(key) - 1 :]


def variants(s: str) -> set[str]:
    """A string and all that one deletion makes of it: strings with one edit between them share one."""
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


def near_words(words: DataFrame, shards: int) -> DataFrame:
    """Every ordered pair of near words: word, other, n (of the other one). words: distinct word, n.

    Each pair comes once: from the half of the other word that this one holds; the first one, if it holds both.
    """
    w = words.select("word", "n", F.char_length("word").alias("len"))
    half = lambda second, size: F.concat(F.lit(str(int(second))), F.expr(f"right(word, {size})" if second else f"left(word, {size})"))
    own = w.select("word", "n", F.explode(F.array(half(False, "len div 2"), half(True, "len - len div 2"))).alias("key"))
    spread = own.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HALF_WORDS).select("key", F.ceil(F.col("c") / HALF_WORDS).cast("int").alias("ways"))
    lengths = [half(False, f"(len + {d}) div 2") for d in (-1, 0, 1)] + [half(True, f"(len + {d}) - (len + {d}) div 2") for d in (-1, 0, 1)]
    seen = w.select(F.col("word").alias("probe"), F.explode(F.array_distinct(F.array(*lengths))).alias("key"))
    way = F.coalesce("ways", F.lit(1))
    own = own.join(spread, "key", "left").withColumn("way", F.pmod(F.xxhash64("word"), way.cast("long")))
    seen = seen.join(spread, "key", "left").withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), way.cast("long") - 1)))
    shard = F.pmod(F.xxhash64("key", "way"), F.lit(shards))
    seen = seen.select("probe", shard.alias("into"))

    def scan(key, owners, scanned):
        shard = Shard(owners["key"].tolist(), owners["word"].tolist())
        n = dict(zip(owners["word"], owners["n"]))
        rows = [(s, w, n[w]) for s in scanned["probe"].unique() for w in shard.partners(s)]  # several ends may send a word here
        return pd.DataFrame(rows, columns=["word", "other", "n"]).astype({"n": "int64"})

    return own.select("key", "word", "n", shard.alias("shard")).groupBy("shard").cogroup(seen.groupBy("into")).applyInPandas(scan, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: follow forms (word, form) to the last one. A form is several times as frequent as its word, so there are
    no circles, and a path doubles its steps each round until none changes."""
    hop = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hop = stored(hop.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if hop.where("moved").isEmpty():
            return hop.select("word", "root")
        hop = hop.select("word", "root")


def variant_groups(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, factor: int = 5) -> DataFrame:
    """word, n, form, form_n, n_near, root for every word of count_words().

    form: the near word of largest n (ties: smallest in code-point order) if that is `factor` times the word's n or more,
    else null, and form_n with it. root: the last form on the way. n_near: number of near words.
    Empty tables and texts without words give no rows. See count_words() for nulls and repeated rows.
    """
    words = stored(count_words(docs, id_col=id_col, text=text, shortest=shortest, least=least))
    shards = words.count() * 2 // SHARD_WORDS + 1
    first = F.min_by(F.struct(F.col("other").alias("form"), F.col("n").alias("form_n")), F.struct(-F.col("n"), "other"))
    best = near_words(words, shards).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    d = words.join(best, "word", "left")
    ok = F.col("best.form_n") >= factor * F.col("n")
    d = stored(d.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("best.form")).alias("form"), F.when(ok, F.col("best.form_n")).alias("form_n")))
    ends = roots(d.where("form is not null"))
    return d.join(ends, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
