"""Suffix-array dedup: maximal repeats of whole bytes, from the common-prefix interval trees of many small suffix arrays.

Every window of LENGTH bytes chooses one of its byte n-grams as anchor by its content alone, so equal windows have
equal anchors at equal places. Anchors that occur twice send the bytes around them to the part of their digest; each
part builds an enhanced suffix array over what it gets and scans its intervals. Parts need nothing of each other.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import slices, stored
from veilframe.llm.jaccard import CELLS, SLICES, _added
from veilframe.llm.katz import BYTE, mix, pair

LENGTH, GRAM = 100, 32
#: Texts go through numpy in pieces of so many bytes (with the windows that begin in them).
PIECE = 1 << 20
#: Anchors in a part, about.
PART_ANCHORS = 12_000
#: Of different texts with one id the k-th has its bytes at k * TEXT and on: places of an id's rows never meet.
TEXT = 1 << 40
STEP = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 28) - 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Digest of the GRAM bytes from each place on (GRAM is a power of 2)."""
    x, k, step = BYTE[data], 1, STEP
    with np.errstate(over="ignore"):
        while k < GRAM:
            x = x[:-k] + step * x[k:]
            step, k = step * step, 2 * k
    return mix(x)


def anchors(texts: list[bytes], length: int, hot: np.ndarray | None):
    """(digest, which text, first window, windows) of the runs of windows that share an anchor.

    A window's anchor is the gram with the smallest digest, one whose cell isn't hot if there is any; the first of equal ones.
    """
    for a, z in slices(texts, PIECE):
        size = np.array([len(t) for t in texts[a:z]])
        data, begin = b"".join(texts[a:z]), np.cumsum(size) - size
        for at in range(0, len(data) - length + 1, PIECE):
            part = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
            n = len(part) - length + 1
            x = grams(part)
            key = x >> np.uint64(1)
            if hot is not None:
                key |= hot[(x >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
            best = (key & ~LOW) | np.arange(len(key), dtype=np.uint64)
            span, want = 1, length - GRAM + 1
            while span < want:
                more = min(span, want - span)
                best = np.minimum(best[: len(best) - more], best[more:])
                span += more
            place = np.arange(at, at + n)
            own = np.searchsorted(begin, place[[0, -1]], "right") - 1
            text = np.repeat(np.arange(own[0], own[1] + 1), np.diff(np.clip(np.append(begin[own[0] : own[1] + 1], at + n), at, None)))
            on = np.flatnonzero(place + length <= (begin + size)[text])  # no window crosses texts
            if len(on):
                anchor, text, place = (best[on] & LOW).astype(np.int64), text[on], place[on]
                first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
                yield x[anchor[first]], text[first] + a, place[first] - begin[text[first]], np.diff(np.append(first, len(on)))


def _survey(length: int):
    """Counts of the grams of all texts by cell, a row for each of SLICES ranges of cells."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            texts = b.column("__text").to_pylist()
            for a, z in slices(texts, PIECE):  # grams across two texts are counted too: that only bears on the choice of anchors
                data = b"".join(texts[a:z])
                for at in range(0, len(data) - GRAM + 1, PIECE):
                    x = grams(np.frombuffer(data, np.uint8, min(PIECE + GRAM - 1, len(data) - at), at))
                    counts += np.bincount((x >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        each, counts = CELLS // SLICES, np.minimum(counts, 2**32 - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([counts[k * each : (k + 1) * each].tobytes() for k in range(SLICES)], pa.binary())], names=["slice", "counts"])

    return run


def _counter(length: int, shipped):
    """How often each batch has each anchor."""

    def run(batches):
        hot = np.unpackbits(np.frombuffer(shipped.value, np.uint8))
        for b in batches:
            found = [x for x, *_ in anchors(b.column("__text").to_pylist(), length, hot)]
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return run


def _owners(length: int, shipped):
    def run(batches):
        hot = np.unpackbits(np.frombuffer(shipped.value, np.uint8))
        for b in batches:
            ids, base = b.column("__id").to_numpy(), b.column("__base").to_numpy()
            for x, text, *_ in anchors(b.column("__text").to_pylist(), length, hot):
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(base[text]), pa.array(x.view(np.int64))], names=["id", "base", "gram"])

    return run


CONTEXT = "gram long, id long, start long, windows int, context binary, end long"
#: With whole: the place of the context that a folded one equals.
OF = ", of_id long, of_start long"


def _contexts(length: int, shipped, whole: bool = False):
    """Bytes around each repeated anchor, the byte before them first (none at a text's start).

    Of equal contexts in a batch only the earliest is sent on; the others come out as removed spans (gram null), or,
    with whole, each with the place of the one sent on.
    """

    def run(batches):
        hot = np.unpackbits(np.frombuffer(shipped.value, np.uint8))
        for b in batches:
            seen: dict = {}
            gone: dict = {}
            equal: list = []
            ids, bases, texts = (b.column(c).to_pylist() for c in ("__id", "__base", "__text"))
            lists = b.column("grams")
            owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            wanted = np.sort(pair(owner.astype(np.uint64), lists.flatten().to_numpy().view(np.uint64)))
            for x, text, first, n in anchors(texts, length, hot):
                key = pair(text.astype(np.uint64), x)
                on = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                for g, d, p, k in zip(x[on].view(np.int64).tolist(), text[on].tolist(), first[on].tolist(), n[on].tolist(), strict=True):
                    t, base = texts[d], bases[d]
                    context = (t[p - 1 : p] if p else b"") + t[p : p + k + length - 1]
                    here, inner = (ids[d], base + p), p > 0
                    old = seen.setdefault((inner, context), (*here, g, k))
                    if old[:2] == here:
                        continue
                    if here < old[:2]:
                        seen[inner, context] = (*here, g, k)
                        here = old[:2]
                    if whole:
                        equal.append(((inner, context), *here, k))
                        continue
                    gone.setdefault(here[0], []).append((here[1], here[1] + k + length - 1))
            rows = [(g, i, p, k, context, p + k + length - 1) for (_, context), (i, p, g, k) in seen.items()]
            rows += [(None, i, p, None, None, e) for i, spans in gone.items() for p, e in merged(spans)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            names = ["gram", "id", "start", "windows", "context", "end"]
            if whole:
                rows = [(*r, None, None) for r in rows] + [(None, i, p, None, None, p + k + length - 1, *seen[key][:2]) for key, i, p, k in equal]
                kinds, names = (*kinds, pa.int64(), pa.int64()), [*names, "of_id", "of_start"]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.nulls(0, k) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def suffix_array(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places in the order of their suffixes, each of which ends at end[place]; and ranks by the first 8, 24, 72, ... bytes."""
    n = len(data)
    place = np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(place + j < end, data[np.minimum(place + j, n - 1)], 0).astype(np.uint64)
    levels, k, longest = [], 8, int((end - place).max())
    times = 3 if n < (1 << 21) - 1 else 2  # ranks of so many stretches fit into 64 bits
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (s[1:] != s[:-1]).astype(np.int64))))
        levels.append((k, rank))
        if k >= longest:
            return order, levels
        for more in range(1, times):
            key = (rank if more == 1 else key) * (n + 1) + np.where(place + more * k < end, rank[np.minimum(place + more * k, n - 1)], 0)
        k *= times


def common_prefixes(a: np.ndarray, b: np.ndarray, data: np.ndarray, end: np.ndarray, levels) -> np.ndarray:
    """Longest common prefix of the suffixes at a and b, pairwise."""
    lcp, n = np.zeros(len(a), np.int64), len(data)
    most = np.minimum(end[a] - a, end[b] - b)
    for k, rank in reversed(levels):
        for _ in range(2):
            lcp += k * ((lcp < most) & (rank[np.minimum(a + lcp, n - 1)] == rank[np.minimum(b + lcp, n - 1)]))
    for _ in range(7):
        lcp += (lcp < most) & (data[np.minimum(a + lcp, n - 1)] == data[np.minimum(b + lcp, n - 1)])
    return np.minimum(lcp, most)


def intervals(lcp: list[int], at_least: int):
    """(length, first, last) of the intervals of the common-prefix tree with a length of at_least, by one scan with a stack.

    lcp[i] is shared by entries i and i + 1 of the suffix array.
    """
    stack: list[list[int]] = []
    for i, value in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            yield length, left, i
        if value >= at_least and (not stack or stack[-1][0] < value):
            stack.append([value, left])


def maximal_repeats(rows: list[tuple], length: int):
    """Maximal repeats among contexts (id, start, windows, context): (bytes long, [(id, start), ...]).

    An interval counts only if its strings can't be extended to the left: the bytes before them differ, or one of
    them stands at the first window of its context (what is left of it has another anchor). No context occurs twice.
    """
    text, end, own, base = [], [], [], 0
    for k, (_, start, windows, context) in enumerate(rows):
        body = context[1:] if start % TEXT else context
        text.append(body)
        end.append(np.full(len(body), base + len(body)))
        own.append(np.full(len(body), k))
        base += len(body)
    data, end, own = np.frombuffer(b"".join(text), np.uint8), np.concatenate(end), np.concatenate(own)
    begin = np.cumsum([len(t) for t in text]) - np.array([len(t) for t in text])
    order, levels = suffix_array(data, end)
    order = order[end[order] - order >= length]
    lcp = common_prefixes(order[:-1], order[1:], data, end, levels)
    long = np.flatnonzero(np.concatenate(([False], lcp >= length, [False])))
    if not len(long):
        return
    offset = order - begin[own[order]]
    at_edge = offset == 0
    before = data[np.maximum(order - 1, 0)]
    ids, starts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    cut = np.flatnonzero(np.diff(long) > 1)
    for a, b in zip(np.concatenate(([0], cut + 1)), np.append(cut, len(long) - 1), strict=True):
        lo, hi = long[a] - 1, long[b]  # entries lo ... hi share `length` bytes each with the next
        for size, first, last in intervals(lcp[lo:hi].tolist(), length):
            i, j = lo + first, lo + last
            e, left = at_edge[i : j + 1], before[i : j + 1]
            if e.any() or (left != left[0]).any():
                k = own[order[i : j + 1]]
                yield size, ids[k], starts[k] + offset[i : j + 1]


def _groups(length: int, whole: bool = False):
    """A part's repeats: a row for each occurrence but for those that were equal contexts, which come as (group null).

    With whole, rows have the place of the context that the occurrence is in, or that the equal context was folded into.
    """

    def run(t: pa.Table) -> pa.Table:
        seen: dict = {}
        gone: dict = {}
        equal: list = []
        by_gram: dict = {}
        for g, i, p, k, context in zip(*[t.column(c).to_pylist() for c in ("gram", "id", "start", "windows", "context")], strict=True):
            key = (p % TEXT > 0, context)
            old = seen.get(key)
            if old is None or (i, p) < old[1:3]:
                seen[key] = (g, i, p, k, context)
            if old is not None and (i, p) != old[1:3]:
                i, p = max((i, p), old[1:3])
                equal.append((key, i, p, p + k + length - 1))
                gone.setdefault(i, []).append((p, p + k + length - 1))
        for g, *row in seen.values():
            by_gram.setdefault(g, []).append(tuple(row))
        out: list[tuple] = [(None, True, i, a, b) for i, spans in gone.items() for a, b in merged(spans)]
        rows = [r for own in by_gram.values() if len(own) > 1 for r in own]  # equal windows lie at different places only in different contexts
        if rows:
            for size, ids, starts in maximal_repeats(rows, length):
                order = np.lexsort((starts, ids))
                i0, s0 = int(ids[order[0]]), int(starts[order[0]])
                name = hashlib.blake2b(b"%d:%d:%d" % (i0, s0, size), digest_size=8).digest()
                name = int.from_bytes(name, "little", signed=True)
                out += [(name, bool(i != i0 or s != s0), int(i), int(s), int(s) + size) for i, s in zip(ids[order], starts[order], strict=True)]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        names = ["group", "later", "id", "start", "end"]
        if whole:
            places = sorted((i, p) for i, p, *_ in rows)  # windows lie in one context each: the last that begins at or before
            out = [(*r, *places[bisect.bisect_right(places, (r[2], r[3])) - 1]) for r in out if r[0] is not None]
            out += [(None, True, i, a, b, *seen[key][1:3]) for key, i, a, b in equal]
            kinds, names = (*kinds, pa.int64(), pa.int64()), [*names, "of_id", "of_start"]
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.nulls(0, k) for k in kinds]
        return pa.Table.from_arrays(cols, names=names)

    return run


def repeat_groups(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Repeated byte strings of at least `length` bytes: rows (group, later, id, nth, start, end), end exclusive.

    A group is a maximal repeat as far as the windows of one anchor reach (up to 2 * length - 32 + 1 bytes), with all its
    occurrences; longer repeats are chains of overlapping groups. later: not the first occurrence, by id and then start.
    Contexts that equal an earlier one byte for byte are folded before the suffix arrays are built, so that many copies
    of one passage never meet in one part; they get the groups of the one that they equal afterwards, at their own
    place. A context that only such copies share is a group of its own.

    Null and short texts have no repeats. Equal rows count as one. Different texts of one id are told apart by nth: which of
    the id's texts it is, in the order of their digests, from 0 (0 for all where ids are unique). Null ids come first. Empty tables give empty results. Nothing is sampled or capped; digests only decide where bytes meet.
    """
    found = stored(_repeats(_placed(docs.select(id_col, text), text, id_col), length, whole=True), release=True)
    group = found.where("group is not null")
    folded = found.where("group is null").select("id", "start", "end", "of_id", "of_start")
    # a context folded in its batch may equal one that was folded later, in its part
    onward = folded.select(F.col("id").alias("of_id"), F.col("start").alias("of_start"), F.col("of_id").alias("to_id"), F.col("of_start").alias("to_start"))
    folded = folded.join(onward.distinct(), ["of_id", "of_start"], "left").select("id", "start", "end", F.coalesce("to_id", "of_id").alias("of_id"), F.coalesce("to_start", "of_start").alias("of_start"))
    folded = stored(folded.where("id <> of_id or start <> of_start").distinct())
    first = folded.select("of_id", "of_start", (F.col("of_start") + F.col("end") - F.col("start")).alias("end")).distinct()
    alone = first.join(group.where("start = of_start").select("of_id", "of_start", "end"), ["of_id", "of_start", "end"], "left_anti")
    alone = alone.select(F.xxhash64("of_id", "of_start", "end").alias("group"), F.lit(False).alias("later"), F.col("of_id").alias("id"), F.col("of_start").alias("start"), "end", "of_id", "of_start")
    group = stored(group.unionByName(alone))
    at = folded.select("of_id", "of_start", F.col("id").alias("__id"), (F.col("start") - F.col("of_start")).alias("by"))
    copies = group.join(at, ["of_id", "of_start"]).select("group", F.lit(True).alias("later"), F.col("__id").alias("id"), (F.col("start") + F.col("by")).alias("start"), (F.col("end") + F.col("by")).alias("end"))
    every = group.select("group", "later", "id", "start", "end").unionByName(copies)
    place = lambda c: (F.col(c) - F.shiftright("start", 40) * TEXT).alias(c)
    return every.select("group", "later", "id", F.shiftright("start", 40).alias("nth"), place("start"), place("end"))


def _placed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """docs with __id (null ids: the smallest number), __text and __base, where the text's bytes begin: 0, or k * TEXT for the
    k-th of several different texts of one id. Only those ids are looked at again, by the digests of their texts."""
    d = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn("__text", F.col(text).cast("binary"))
    digest = F.sha2(F.coalesce("__text", F.lit(b"")), 256).alias("__digest")
    twice = stored(d.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"))
    if not twice.isEmpty():
        kinds = d.select("__id", digest).join(twice, "__id", "left_semi").distinct()
        nth = F.row_number().over(Window.partitionBy("__id").orderBy("__digest")) - 1
        kinds = stored(kinds.withColumn("__nth", nth).where("__nth > 0"))
        if not kinds.isEmpty():
            return d.withColumn("__digest", digest).join(kinds, ["__id", "__digest"], "left").withColumn("__base", F.coalesce("__nth", F.lit(0)).cast("long") * TEXT).drop("__digest", "__nth")
    return d.withColumn("__base", F.lit(0).cast("long"))


def _repeats(placed: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """Rows (group, later, id, start, end): occurrences in contexts that weren't folded; group null: spans of folded
    contexts, or with whole each folded context, and of_id and of_start as _groups() has them."""
    spark = placed.sparkSession
    work = placed.select("__id", "__base", "__text").where(F.octet_length("__text") >= length)
    cells = {r.slice: np.frombuffer(bytes(r.counts), np.uint32) for r in work.select("__text").mapInArrow(_survey(length), "slice int, counts binary").groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect()}
    counts = np.concatenate([cells[k] for k in sorted(cells)]) if cells else np.zeros(CELLS, np.uint32)
    hot = counts > 50 + 3 * counts.mean()
    shipped = spark.sparkContext.broadcast(np.packbits(hot).tobytes())

    twice = work.select("__text").mapInArrow(_counter(length, shipped), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    owners = work.mapInArrow(_owners(length, shipped), "id long, base long, gram long").join(twice, "gram")
    lists = stored(owners.groupBy("id", "base").agg(F.collect_set("gram").alias("grams")), release=True)
    total = lists.agg(F.sum(F.size("grams"))).first()[0] or 0
    parts = max(1, -(-total // PART_ANCHORS))
    joined = work.join(lists.withColumnsRenamed({"id": "__id", "base": "__base"}), ["__id", "__base"])
    of = OF if whole else ""
    found = joined.mapInArrow(_contexts(length, shipped, whole), CONTEXT + of)
    found = stored(found, release=True)
    folded = found.where("gram is null").select(F.lit(None).cast("long").alias("group"), F.lit(True).alias("later"), "id", "start", "end", *(["of_id", "of_start"] if whole else []))
    sent = found.where("gram is not null").withColumn("part", F.pmod(F.col("gram"), F.lit(parts)))
    groups = sent.groupBy("part").applyInArrow(_groups(length, whole), "group long, later boolean, id long, start long, end long" + of)
    return groups.unionByName(folded)


def remove_repeats(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Add removed (array of (start, end) byte offsets, maximal runs) and kept (binary: the other bytes) to docs.

    A byte is removed if a string of `length` bytes that covers it also starts earlier: at a smaller id, in a text of the
    same id that has a smaller digest, or earlier in the same text; equal rows stay alike. Null texts are kept as empty bytes. See repeat_groups() for the rest; other columns pass through,
    those named like the added ones are replaced.
    """
    d = _placed(docs.drop("removed", "kept"), text, id_col)
    base = F.shiftright("start", 40) * TEXT
    spans = _repeats(d, length).where("later").select(F.col("id").alias("__id"), base.alias("__base"), F.struct((F.col("start") - base).alias("start"), (F.col("end") - base).alias("end")).alias("s"))
    spans = stored(spans.groupBy("__id", "__base").agg(F.array_sort(F.collect_set("s")).alias("__spans")))
    d = d.drop("__text").join(spans, ["__id", "__base"], "left").drop("__id", "__base")
    d = d.withColumn("removed", F.expr("cast(array() as array<struct<start:long,end:long>>)")).withColumn("kept", F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for b in batches:
            removed, kept = [], []
            for t, spans in zip(b.column("kept").to_pylist(), b.column("__spans").to_pylist(), strict=True):
                runs = merged([(s["start"], s["end"]) for s in spans or []])
                removed.append([{"start": x, "end": y} for x, y in runs])
                kept.append(b"".join(t[x:y] for x, y in zip([0] + [y for _, y in runs], [x for x, _ in runs] + [len(t)], strict=True)))
            new = {"removed": pa.array(removed, kind), "kept": pa.array(kept, pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], names=b.schema.names)

    return d.mapInArrow(cut, d.schema).drop("__spans")
