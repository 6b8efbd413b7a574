"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, run over each text once."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import parts, stored

#: Bytes that belong to no word become a space, A-Z become a-z; bytes from 0x80 are letters of a word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WINDOW = 10
#: Items are taken in blocks of so many bytes; each block's automaton takes some 150 times as much memory in a worker.
BLOCK_BYTES = 3_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


#: Words are written as letters of so many kinds, since a node of the automaton looks through its edges one by one.
BASE = 128


class Windows:
    """Automaton over the windows of items (item_id, text). Each word of the items is a code of `size` letters; the first
    letter of a code is of another alphabet than the rest, so that matches begin and end with words.

    Its values are (words of the window, items that have it).
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import ahocorasick

        texts = [(item, words_of(text or b"")) for item, text in items]
        known = sorted({w for _, words in texts for w in words})
        self.size = 1
        while BASE**self.size < len(known):
            self.size += 1
        self.code = {w: "".join(chr((0x100 if k == 0 else 0x200) + i // BASE**k % BASE) for k in range(self.size)) for i, w in enumerate(known)}
        self.other = chr(0x300) * self.size
        at: dict[str, tuple[int, set]] = {}
        for item, words in texts:
            for i in range(max(1, len(words) - width + 1) if words else 0):
                own = words[i : i + width]
                at.setdefault("".join([self.code[w] for w in own]), (len(own), set()))[1].add(item)
        self.auto = ahocorasick.Automaton() if at else None
        while at:
            w, (n, ids) = at.popitem()
            self.auto.add_word(w, (n, sorted(ids)))
        if self.auto is not None:
            self.auto.make_automaton()


def hit_runs(words: list[bytes], windows: Windows) -> tuple[list[tuple[int, int]], set]:
    """Runs [first word, end word) that windows cover, merged; and the items found."""
    found: set = set()
    if windows.auto is None or not words:
        return [], found
    code, other, runs = windows.code.get, windows.other, []
    for end, (n, ids) in windows.auto.iter("".join([code(w, other) for w in words])):
        found.update(ids)
        last = (end + 1) // windows.size
        runs.append((last - n, last))
    return merge(runs), found


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def places(text: bytes, words: list[bytes], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text that the word runs cover."""
    if not runs:
        return []
    is_word = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    first = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1])))
    stop = np.flatnonzero(is_word & ~np.concatenate((is_word[1:], [False]))) + 1
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # bytes that begin a code point
    point = np.concatenate(([0], np.cumsum(begins)))
    return [(int(point[first[a]]), int(point[stop[b - 1]])) for a, b in runs]


RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RUNS = "array<struct<start:int,end:int>>"

_kept: dict = {}


def _windows(shipped, name: str, width: int) -> Windows:
    """A block's automaton; a worker process keeps the one that it has built last for its next tasks."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Windows(shipped.value, width)
    return _kept[name]


def _structs(runs):
    return [{"start": a, "end": b} for a, b in runs]


def _scanner(shipped, name: str, width: int):
    """All rows with what a single block finds in them."""

    def run(batches):
        windows = _windows(shipped, name, width)
        for batch in (part for whole in batches for part in parts(whole, "__text")):
            new: dict = {"n_words": [], "n_hit": [], "hit_spans": [], "hit_items": []}
            for t in batch.column("__text").to_pylist():
                t = t or b""
                words = words_of(t)
                runs, found = hit_runs(words, windows)
                for c, v in zip(new.values(), (len(words), sum(b - a for a, b in runs), _structs(places(t, words, runs)), sorted(found)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(new[c], KINDS[c]) if c in new else batch.column(i) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return run


def _finder(shipped, name: str, width: int):
    """Rows (numbered) that a block's windows occur in: runs of words and items."""

    def run(batches):
        windows = _windows(shipped, name, width)
        for batch in (part for whole in batches for part in parts(whole, "__text")):
            rows, runs, items = [], [], []
            for row, t in zip(batch.column("__row").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                got, found = hit_runs(words_of(t or b""), windows)
                if got:
                    rows.append(row)
                    runs.append(_structs(got))
                    items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(runs, RUN), pa.array(items, pa.list_(pa.string()))], names=["__row", "__runs", "__items"])

    return run


def _joiner(batches):
    """Puts the runs that several blocks have found in a text together."""
    for batch in (part for whole in batches for part in parts(whole, "__text")):
        new: dict = {"n_words": [], "n_hit": [], "hit_spans": [], "hit_items": []}
        for t, runs, items in zip(*(batch.column(c).to_pylist() for c in ("__text", "__runs", "__items")), strict=True):
            words = words_of(t or b"")
            runs = merge([(x["start"], x["end"]) for x in runs or []])
            for c, v in zip(new.values(), (len(words), sum(b - a for a, b in runs), _structs(places(t or b"", words, runs)), sorted(set(items or []))), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(new[c], KINDS[c]) if c in new else batch.column(i) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)


ADDED = {"n_words": "long", "n_hit": "long", "hit_spans": RUNS, "hit_items": "array<string>"}
KINDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "hit_spans": RUN, "hit_items": pa.list_(pa.string())}


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, hit_spans (code points of the original text, end exclusive) and hit_items to docs.

    Words are runs of digits, ASCII letters (case folded) and bytes beyond ASCII. An item's windows are its runs of
    `width` words, or all its words if it has fewer; a word of a text is hit if some window that covers it occurs.
    The items (questions and answers) are broadcast in blocks of about block_bytes, whose number is counted first. A
    worker process builds a block's automaton once. With one block texts are only read; with more, the rows are
    numbered in the shared folder, each block reads them once and gives the numbers of the texts that it occurs in, and
    only these are joined.

    Null texts have no words; items without words occur nowhere; equal items are all found; items with a null id are
    left out. Repeated rows are scanned each for itself. Empty tables work on either side. Columns of docs named like
    the added ones are replaced.
    """
    spark = docs.sparkSession
    items = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    own = [c for c in docs.columns if c not in ADDED]
    texts = docs.select(*own, F.col(text).cast("binary").alias("__text"))
    result = texts.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in ADDED.items()])
    load = lambda k: spark.sparkContext.broadcast([(r.id, bytes(r.t or b"")) for r in (items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else items).collect()])
    if blocks == 1:
        return result.mapInArrow(_scanner(load(0), uuid.uuid4().hex, width), result.schema).drop("__text")
    rows = stored(texts.withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for k in range(blocks):
        shipped = load(k)
        hits = stored(rows.select("__row", "__text").mapInArrow(_finder(shipped, uuid.uuid4().hex, width), f"__row long, __runs {RUNS}, __items array<string>"))
        shipped.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("__row").agg(F.flatten(F.collect_list("__runs")).alias("__runs"), F.flatten(F.collect_list("__items")).alias("__items"))
    both = rows.join(found, "__row", "left").drop("__row").select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in ADDED.items()])
    return both.mapInArrow(_joiner, both.schema).drop("__text", "__runs", "__items")


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark where item_id is not null),
iw as (select distinct item_id, least(10, len(ws)) k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') t from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) i from b where len(ws) > 0)),
ks as (select distinct k from iw),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') t from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) i from w, ks where len(ws) >= k)),
h as (select doc_id, i, dw.k, item_id from dw join iw on dw.k = iw.k and dw.t = iw.t),
hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from h)) group by 1),
hi as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id::varchar item_id from h) group by 1)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join hw using (doc_id) left join hi using (doc_id)"""
