"""LM scoring: a Katz backoff model of any order over a whole corpus, counted and evaluated part by part.

    P(w | h) = d(c) c(h, w) / c(h) if the n-gram was seen, else alpha(h) P(w | h without its first word)

down to P(w) = d(c) c(w) / N, with one class for all unseen words. d are Good-Turing discounts; alpha(h) hands what they
freed to the words not seen after h, so that every history's probabilities add up to 1.

An n-gram goes to the part of the last word of its history, so that one part has every count, history total and backoff
weight that the recursion asks for. Exceptions travel as small tables between two passes over the texts:

- words so frequent that they would fill a part are spread by the word before them; their bigrams are added up elsewhere
- words outside of the dictionary (the DICT most frequent ones, which is broadcast) have their totals only in their own part

The first pass sends counts, the second one occurrences, which are scored on arrival. The driver gets the dictionary, the
counts of counts, and sums for frequent words and n-grams: all bounded by DICT and 1 / HOT.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import pack, parts, ranks, runs, small, stored, unpack

#: Lower-case A-Z only; space and \t-\r part the words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
BYTE = np.random.default_rng(54321).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
START, END = np.uint64(1), np.uint64(2)
#: Texts are hashed in chunks of about so many bytes.
CHUNK = 1 << 21
#: Good-Turing discounts counts up to so many; larger counts lose half an occurrence.
K = 5
#: Words that are this share of all tokens may be spread over parts, n-grams of this share are scored where they occur.
HOT = 1e-5
#: The dictionary has so many words at most.
DICT = 1 << 20
#: Bytes of text for each part, and of a block, which sends each part one cell.
PART_BYTES, BLOCK_BYTES = 12_000_000, 8_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * STEP + mix(w))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, word, which text) of every token, each text's end included."""
    hs, ws, ds, own, held = [], [], [], [], 0
    for i, t in enumerate(texts):
        own.append(t)
        held += len(t)
        if held >= CHUNK or i == len(texts) - 1:
            h, w, d = _tokens(own)
            hs.append(h)
            ws.append(w)
            ds.append(d + (i + 1 - len(own)))
            own, held = [], 0
    none = np.empty(0, np.uint64)
    return (np.concatenate(hs), np.concatenate(ws), np.concatenate(ds)) if hs else (none, none, np.empty(0, np.int64))


def _tokens(texts: list[bytes]):
    data = np.frombuffer((b"\n".join(texts) + b"\n").translate(FOLD), np.uint8)
    blank = SPACE[data]
    first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    stop = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
    edges = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(edges, first, "right")
    size = stop - first
    if len(first):
        inner = np.flatnonzero(~blank)
        word_at = np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max()) - 1, STEP, np.uint64))))
        word = mix(np.add.reduceat(BYTE[data[inner]] * power[np.arange(len(inner)) - word_at], np.cumsum(size) - size) + size.astype(np.uint64))
    else:
        word = np.empty(0, np.uint64)
    n = np.bincount(doc, minlength=len(texts)) + 1
    ends = np.cumsum(n)
    w = np.empty(int(ends[-1]), np.uint64)
    last = np.zeros(len(w), bool)
    last[ends - 1] = True
    w[last], w[~last] = END, word
    h = np.concatenate((w[-1:], w[:-1]))
    h[ends - n] = START
    return h, w, np.repeat(np.arange(len(texts)), n)


def discounts(of: dict[int, int], k: int = K) -> np.ndarray:
    """d(1) ... d(k) from the counts of counts; where Good-Turing gives none between 0 and 1: (r - 1/2) / r."""
    out = [(r - 0.5) / r for r in range(1, k + 1)]
    n1, last = of.get(1, 0), of.get(k + 1, 0)
    common = (k + 1) * last / n1 if n1 else 1.0
    if common < 1:
        for r in range(1, k + 1):
            if of.get(r) and of.get(r + 1):
                d = ((r + 1) * of[r + 1] / of[r] / r - common) / (1 - common)
                if 0 < d < 1:
                    out[r - 1] = d
    return np.array(out)


def reduced(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c."""
    return np.where(c <= len(d), np.append(0.0, d)[np.minimum(c, len(d))] * c, c - 0.5)


def _order(cols: list[np.ndarray]) -> np.ndarray:
    """Sorts rows by the first column, then by the second one, and so on."""
    if len(cols) <= 3 and all(len(c) == 0 or int(c.max()) < 1 << 21 for c in cols):
        key = np.zeros(len(cols[0]), np.uint64)
        for c in cols:
            key = (key << np.uint64(21)) | c.astype(np.uint64)
        return np.argsort(key)
    return np.lexsort(cols[::-1])


def _find(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where x is in the sorted array; -1 if it isn't."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


# --- the dictionary


class _Words:
    """Codes of the most frequent words (0: start, then by frequency) and their counts; what every task gets."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, kinds: int, d1: np.ndarray, unknown: float, n_train: int, parts: int):
        order = np.lexsort((keys, -counts))
        self.digest = np.concatenate(([START], keys[order]))
        self.count = np.concatenate(([n_train], counts[order])).astype(np.int64)
        self.sorted = np.sort(keys)
        self.code = np.empty(len(keys), np.uint32)
        self.code[np.searchsorted(self.sorted, keys[order])] = np.arange(1, len(keys) + 1)
        self.size, self.total, self.kinds, self.d1, self.parts = len(self.digest), total, kinds, d1, parts
        self.hot = self.count >= max(HOT * total, total / (2 * parts), 2)
        self.unknown = unknown

    def p(self, count: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts."""
        return np.where(count > 0, reduced(count, self.d1) / max(self.total, 1), self.unknown)

    def encode(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes; words that are not in the dictionary get the next ones, in the order of the digests returned."""
        keys, inv = np.unique(w, return_inverse=True)
        at = _find(keys, self.sorted)
        rare = at < 0
        code = np.empty(len(keys), np.uint32)
        code[~rare] = self.code[at[~rare]]
        code[rare] = self.size + np.arange(rare.sum())
        return code[inv], keys[rare]

    def part(self, h1: np.ndarray, h2: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The part of n-grams by the last two words of their histories."""
        digest = np.concatenate((self.digest, extra))
        hot = np.append(self.hot, np.zeros(len(extra), bool))
        key = np.where(hot[h1], pair(digest[h1], digest[h2]), mix(digest[h1]))
        return (((key >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int64)


def _own(cols: list[np.ndarray], extra: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns with codes for only those words outside of the dictionary that they have, and these."""
    flat = np.concatenate(cols)
    rare = flat >= size
    used, inv = np.unique(flat[rare], return_inverse=True)
    flat = flat.copy()
    flat[rare] = size + inv
    return np.split(flat, len(cols)), extra[used - size]


def _joined(bodies: list[list[np.ndarray]], n: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The first n columns of unpacked bodies, whose last array has the words outside of the dictionary; and these."""
    if not bodies:
        return [np.empty(0, np.uint32)] * n, np.empty(0, np.uint64)
    extra = np.unique(np.concatenate([b[-1] for b in bodies]))
    cols = []
    for b in bodies:
        to = (size + np.searchsorted(extra, b[-1])).astype(np.uint32)
        cols.append([np.where(c >= size, to[np.maximum(c.astype(np.int64) - size, 0)], c) if len(to) else c for c in b[:n]])
    return [np.concatenate(c) for c in zip(*cols, strict=True)], extra


def _blocks(batches):
    """(name, ids, train, texts): blocks are named by task and order, so that a task that runs again makes the same ones."""
    task = TaskContext.get()
    name = (task.partitionId() if task else 0) << 32
    for b in (part for whole in batches for part in parts(whole, "__text", BLOCK_BYTES)):
        yield name, b.column("__id").to_numpy(zero_copy_only=False), b.column("__train").to_numpy(zero_copy_only=False), b.column("__text").to_pylist()
        name += 1


def _histories(code: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """The n codes before every token, the nearest first; 0 before a text's start."""
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    out, back = [], code
    for _ in range(n):
        back = np.concatenate((np.zeros(1, code.dtype), back[:-1]))
        back[first] = 0
        out.append(back)
    return out


def _name(cols: list[np.ndarray], digest: np.ndarray, order: int) -> np.ndarray:
    """A digest of the n-gram of each row of (h1, h2, ..., w)."""
    key = mix(digest[cols[-1]])
    for c in cols[: order - 1]:
        key = pair(digest[c], key)
    return key


CELLS = "part int, kind int, block long, body binary"
OCCURS, TEXTS, MASS, TOTALS = 0, 1, 2, 3


def _sender(shipped, order: int, hot_grams=None):
    """Cells of a block for each part. Without hot_grams: counts alone, of what the counting pass needs."""
    width = max(order, 3)

    def run(batches):
        words = shipped.value
        for block, ids, train, texts in _blocks(batches):
            _, w, doc = tokens(texts)
            code, extra = words.encode(w)
            cols = [*_histories(code, doc, width - 1), code]
            digest = np.concatenate((words.digest, extra))
            keep = train[doc]
            out = []
            if hot_grams is None:
                hot = np.append(words.hot, np.zeros(len(extra), bool))
                use = keep | hot[cols[0]]
                cols, keep, doc = [c[use] for c in cols], keep[use], doc[use]
            go = _order(cols)
            cols, keep, doc = [c[go] for c in cols], keep[go], doc[go]
            starts = runs(*cols) if len(keep) else np.empty(0, np.int64)
            count = np.add.reduceat(keep.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
            many = np.diff(np.append(starts, len(keep)))
            cols = [c[starts] for c in cols]
            send = np.ones(len(starts), bool)
            if hot_grams is not None:
                known, value = hot_grams.value
                at = _find(_name(cols, digest, order), known) if order > 1 else np.full(len(starts), -1)
                send = at < 0
                x = np.bincount(doc, np.repeat(np.where(send, 0.0, value[at] if len(value) else 0.0), many), len(texts))
                c = np.append(words.count, np.zeros(len(extra), np.int64))[code]
                common = code < words.size
                d = np.repeat(np.arange(len(texts)), np.bincount(doc, minlength=len(texts)))
                base = np.bincount(d, np.where(common, np.log10(c + 1.0), 0), len(texts))
                body = pack(ids.astype(np.int64), np.bincount(d, minlength=len(texts)), np.bincount(d, common & (c > 0), len(texts)).astype(np.int64), base, x)
                out.append((int(block) % words.parts, TEXTS, block, body))
            part = words.part(cols[0], cols[1], extra)
            by = np.argsort(part.astype(np.uint16) if words.parts < 65536 else part, kind="stable")
            cuts = np.append(runs(part[by]) if len(by) else [], len(by)).astype(np.int64)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                e = by[a:z]
                own, rare = _own([c[e] for c in cols], extra, words.size)
                more = []
                if hot_grams is not None:
                    n = np.where(send[e], many[e], 0)
                    at = np.repeat(starts[e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    more = [small(n), doc[at].astype(np.uint16 if len(texts) < 65536 else np.uint32)]
                out.append((int(part[e[0]]), OCCURS, block, pack(*own, small(count[e]), *more, rare)))
            for i in range(0, len(out), 256):
                p, k, b, body = zip(*out[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.int64()), pa.array(body, pa.binary())], names=["part", "kind", "block", "body"])

    return run


class _Part:
    """The n-grams of a part, sorted by history, with their counts in training; inv: n-gram of each entry."""

    def __init__(self, bodies: list[list[np.ndarray]], width: int, words: _Words):
        self.words = words
        cols, self.extra = _joined(bodies, width, words.size)
        count = np.concatenate([b[width] for b in bodies]).astype(np.int64) if bodies else np.empty(0, np.int64)
        go = _order(cols)
        starts = runs(*[c[go] for c in cols]) if len(go) else np.empty(0, np.int64)
        self.inv = np.empty(len(go), np.int64)
        self.inv[go] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(go))))
        self.cols = [c[go[starts]] for c in cols]
        self.count = np.bincount(self.inv, count, len(starts)).astype(np.int64)
        #: histories of 1, 2, ... words: the number of each n-gram's, and their counts
        self.context = [None, *(ranks(*self.cols[: j + 1]) for j in range(width - 1))]
        self.of_context = [None, *(np.bincount(c, self.count, int(c[-1]) + 1 if len(c) else 0).astype(np.int64) for c in self.context[1:])]
        self.hot = np.append(words.hot, np.zeros(len(self.extra), bool))[self.cols[0]]
        self.digest = np.concatenate((words.digest, self.extra))
        self.word_count = np.append(words.count, np.zeros(len(self.extra), np.int64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k-grams that end the n-grams: a row of each, the number of each row's, and their counts."""
        if k == len(self.cols):
            return np.arange(len(self.count)), np.arange(len(self.count)), self.count
        key = (self.context[k - 1] << 32) | self.cols[-1].astype(np.int64)
        _, row, inv = np.unique(key, return_index=True, return_inverse=True)
        return row, inv, np.bincount(inv, self.count, len(row)).astype(np.int64)

    def rare(self, rows=slice(None)) -> np.ndarray:
        return self.cols[0][rows] >= self.words.size


FOUND = "kind int, part int, block long, a long, b long, x double, body binary"
HIST, WORD, GRAM, ASK = 10, 11, 12, 13


def _found(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def _histogram(order: int, count: np.ndarray) -> list[tuple]:
    n = np.bincount(np.minimum(count[count > 0], K + 2), minlength=K + 3)
    return [(HIST, 0, 0, order, r, float(n[r]), None) for r in range(1, K + 2) if n[r]]


def _counter(shipped, order: int, frequent: float):
    """What the second pass has to know of a part: counts of counts, frequent n-grams, bigrams of words that are spread
    over parts, and how much of P(w) follows each history in words outside of the dictionary."""
    width = max(order, 3)

    def run(cells: pa.Table) -> pa.Table:
        words = shipped.value
        me = cells.column("part")[0].as_py()
        part = _Part([unpack(x) for x in cells.column("body").to_pylist()], width, words)
        out = []
        for k in range(2, order + 1):
            row, _, count = part.grams(k)
            local = ~part.hot[row] if k == 2 else np.ones(len(row), bool)
            out += _histogram(k, count[local])
            if k == order:
                top = local & (count >= frequent)
                name = _name([c[row[top]] for c in part.cols], part.digest, order).view(np.int64)
                total = np.where(part.hot[row[top]] & (k == 2), part.word_count[part.cols[0][row[top]]], part.of_context[k - 1][part.context[k - 1][row[top]]])
                out += [(GRAM, 0, 0, int(a), int(b), float(c), None) for a, b, c in zip(name, total, count[top], strict=True)]
        if order > 1:
            # words outside of the dictionary after each history
            first = runs(part.context[2]) if len(part.count) else np.empty(0, np.int64)
            first = first[part.rare(first) & (part.of_context[2] > 0)]
            p = words.p(part.of_context[1][part.context[1][first]])
            before, inv = np.unique(part.cols[1][first], return_inverse=True)
            p = np.bincount(inv, p, len(before))
            spread = np.append(words.hot, np.zeros(len(part.extra), bool))[before]
            out += [(WORD, 0, 0, int(a), K + 2, float(x), None) for a, x in zip(before[spread], p[spread], strict=True)]
            before, p = before[~spread], p[~spread]
            to = words.part(before, before, part.extra)
            for q in np.unique(to):
                own, rare = _own([before[to == q]], part.extra, words.size)
                out.append((MASS, int(q), 0, 0, 0, 0.0, pack(*own, p[to == q], rare)))
            # bigrams of spread words
            row, _, count = part.grams(2)
            row, count = row[part.hot[row]], count[part.hot[row]]
            h, w = part.cols[0][row], part.cols[-1][row]
            to = (((pair(part.digest[h], part.digest[w]) >> np.uint64(32)) * np.uint64(words.parts)) >> np.uint64(32)).astype(np.int64)
            for q in np.unique(to):
                own, rare = _own([h[to == q], w[to == q]], part.extra, words.size)
                out.append((ASK, int(q), me, 0, 0, 0.0, pack(*own, small(count[to == q]), rare)))
        return _found(out)

    return run


def _adder(shipped, order: int, frequent: float):
    """Totals of spread words' bigrams, sent back to those who have them, and what these words' histories come to."""

    def run(asked: pa.Table) -> pa.Table:
        words = shipped.value
        who, bodies = asked.column("block").to_pylist(), [unpack(x) for x in asked.column("body").to_pylist()]
        cols, extra = _joined(bodies, 2, words.size)
        count = np.concatenate([b[2] for b in bodies]).astype(np.int64)
        key, inv = np.unique((cols[0].astype(np.int64) << 32) | cols[1], return_inverse=True)
        total = np.bincount(inv, count, len(key)).astype(np.int64)
        out = _histogram(2, total)
        h, w = key >> 32, key & 0xFFFFFFFF
        seen = total > 0
        of = h[seen] * (K + 2) + np.minimum(total[seen], K + 1)
        at, n = np.unique(of, return_counts=True)
        out += [(WORD, 0, 0, int(a // (K + 2)), int(a % (K + 2)), float(x), None) for a, x in zip(at, n, strict=True)]
        common = seen & (w < words.size)
        at, i = np.unique(h[common], return_inverse=True)
        p = np.bincount(i, words.p(words.count[w[common]]), len(at))
        out += [(WORD, 0, 0, int(a), K + 2, float(x), None) for a, x in zip(at, p, strict=True)]
        if order == 2:
            top = np.flatnonzero(total >= frequent)
            name = _name([h[top], w[top]], np.concatenate((words.digest, extra)), 2).view(np.int64)
            out += [(GRAM, 0, 0, int(a), int(b), float(c), None) for a, b, c in zip(name, words.count[h[top]], total[top], strict=True)]
        at = 0
        for one, body in zip(who, bodies, strict=True):
            n = len(body[0])
            out.append((TOTALS, int(one), 0, 0, 0, 0.0, pack(body[0], body[1], small(total[inv[at : at + n]]), body[-1])))
            at += n
        return _found(out)

    return run


def _backoff(part: _Part, order: int, disc: list[np.ndarray], freed_of: np.ndarray, mass_of: np.ndarray, mass: list, totals: list) -> np.ndarray:
    """log10 P of each n-gram's last word, without what P(w) gives to words outside of the dictionary."""
    words = part.words
    w = part.cols[-1]
    known = w < words.size
    p_low = np.where(known, words.p(part.word_count[w]), 0.0)
    out = np.where(known, np.log10(np.maximum(p_low, 1e-300)), 0.0)
    for k in range(2, order + 1):
        row, inv, count = part.grams(k)
        of = part.context[k - 1][row]
        n = part.of_context[k - 1].astype(float)
        more = np.zeros(len(n))
        first = runs(part.context[k - 1])
        if k == 2:
            hot = part.hot[row]
            if hot.any():
                (h, x), extra = _joined(totals, 2, words.size)
                there = np.concatenate([t[2] for t in totals]).astype(np.int64)
                # both sides' words outside of the dictionary by their digests
                key = pair(np.concatenate((words.digest, extra))[h], mix(np.concatenate((words.digest, extra))[x]))
                go = np.argsort(key)
                at = _find(pair(part.digest[part.cols[0][row[hot]]], mix(part.digest[w[row[hot]]])), key[go])
                count = count.copy()
                count[hot] = there[go][at]
            n = np.where(part.hot[first], part.word_count[part.cols[0][first]], n)
            if mass:
                (h,), extra = _joined([[m[0], m[-1]] for m in mass], 1, words.size)
                value = np.concatenate([m[1] for m in mass])
                digest = np.concatenate((words.digest, extra))[h]
                keys, i = np.unique(digest, return_inverse=True)
                at = _find(part.digest[part.cols[0][first]], keys)
                more = np.where(at >= 0, np.bincount(i, value, len(keys))[at], 0.0)
        seen = count > 0
        less = reduced(count, disc[k])
        freed = np.bincount(of[seen], (count - less)[seen], len(n)).astype(float)  # whole numbers if nothing is seen
        taken = np.bincount(of[seen], p_low[row[seen]], len(n)).astype(float) + more
        if k == 2:
            h = part.cols[0][first]
            hot = part.hot[first]
            freed[hot], taken[hot] = freed_of[h[hot]], mass_of[h[hot]]
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(n > 0, np.log10(freed / n) - np.log10(1 - taken), 0.0)
            p = np.where(seen, less / n[of], 0.0)
            out = np.where(seen[inv], np.log10(p)[inv], alpha[part.context[k - 1]] + out)
        p_low = p[inv]
    return out


def _scorer(shipped, order: int, disc: list[np.ndarray], spread):
    """Sums of each text's tokens in a part."""
    width = max(order, 3)

    def run(cells: pa.Table) -> pa.Table:
        words = shipped.value
        kinds, blocks, raw = cells.column("kind").to_pylist(), cells.column("block").to_pylist(), cells.column("body").to_pylist()
        names, out = [b for b, k in zip(blocks, kinds, strict=True) if k == TEXTS], [b for b, k in zip(raw, kinds, strict=True) if k == TEXTS]
        whole = [True] * len(out)
        bodies = {k: [unpack(b) for b, x in zip(raw, kinds, strict=True) if x == k] for k in (OCCURS, MASS, TOTALS)}
        own = [b for b, k in zip(blocks, kinds, strict=True) if k == OCCURS]
        raw = None
        if own:
            part = _Part(bodies[OCCURS], width, words)
            freed, mass = spread.value
            x = _backoff(part, order, disc, freed, mass, bodies[MASS], bodies[TOTALS])
            # what only the part of a word outside of the dictionary knows of it
            rare = part.rare()
            c = part.of_context[1][part.context[1]]
            x += np.where(rare & ((part.of_context[2][part.context[2]] == 0) | (order == 1)), np.log10(words.p(c)), 0.0)
            base, known = np.where(rare, np.log10(c + 1.0), 0.0), rare & (c > 0)
            at = 0
            for name, body in zip(own, bodies[OCCURS], strict=True):
                many, docs = body[width + 1].astype(np.int64), body[width + 2]
                e = np.repeat(part.inv[at : at + len(many)], many)
                at += len(many)
                if not len(e):
                    continue
                there, inv = np.unique(docs, return_inverse=True)
                r = rare[e]
                late, i = np.unique(docs[r], return_inverse=True)
                names.append(name)
                whole.append(False)
                out.append(pack(there, np.bincount(inv, x[e]), late, small(np.bincount(i, known[e][r], len(late)).astype(np.int64)), np.bincount(i, base[e][r], len(late))))
        return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(whole, pa.bool_()), pa.array(out, pa.binary())], names=["block", "whole", "body"])

    return run


def _gather(sums: pa.Table) -> pa.Table:
    """A block's texts with the sums of all parts."""
    whole, bodies = sums.column("whole").to_pylist(), [unpack(b) for b in sums.column("body").to_pylist()]
    ids, n, known, base, x = bodies[whole.index(True)]
    known, base, x = known.copy(), base.copy(), x.copy()
    for (there, own, late, k, b), w in zip(bodies, whole, strict=True):
        if not w:
            x[there] += own
            known[late] += k
            base[late] += b
    return pa.table({"id": ids, "n_tokens": n, "n_known": known, "base": base, "x": x})


def score_texts(docs: DataFrame, train: Column, *, text: str = "text", id_col: str = "doc_id", order: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """Katz score of every text by n-grams of `order` words, from counts over the rows where train is true.

    Returns, for each row of docs, id_col, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigrams), score (log10 probability). Words are runs of other characters than space and \\t-\\r,
    A-Z folded; starts stand before the first word. A word unseen in training is one class, 'unknown', so that for every
    history the probabilities of all seen words and of that class add up to 1.

    Cells have one entry for each n-gram of a block of texts and two bytes for each occurrence. n-grams that are HOT
    of all tokens (a line in every text) are sent as counts only and scored in place. What is not split is one history
    of two words. Words are 64-bit digests: with 10^9 different ones, two would be merged with a chance of about 3 %.

    Null and empty texts have the end alone. No training rows: every token is unknown (probability 1; score 0).
    Ids are whole numbers or null and mean nothing here: repeated ones get a row each. Empty tables give empty results.
    """
    spark = docs.sparkSession
    ship = spark.sparkContext.broadcast
    work = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(train, F.lit(False)).alias("__train"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__text"))
    missing = -(2**63)
    work = work.withColumn("__id", F.coalesce("__id", F.lit(missing)))

    # words, and what is known of them as a whole
    level = F.when(F.col("n") <= 64, F.col("n")).otherwise(64 + F.floor(8 * (F.log2("n") - 6))).cast("int")
    counted = stored(work.mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    words = counted.where(F.col("w") != int(START)).withColumn("level", level)
    n_bytes = counted.where(F.col("w") == int(START)).agg(F.sum("n")).first()[0] or 0
    levels = {r.level: (r.k, r.n) for r in words.groupBy("level").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    total, kinds = sum(n for _, n in levels.values()), sum(k for k, _ in levels.values())
    d1 = discounts({r: levels.get(r, (0, 0))[0] for r in range(1, K + 2)})
    least, held = 1 << 30, 0
    for at in sorted(levels, reverse=True):
        held += levels[at][0]
        if held > DICT:
            break
        least = at
    listed = words.where((F.col("level") >= least) | (F.col("w") == int(END))).select("w", "n").toArrow()
    keys, counts = listed.column("w").to_numpy().view(np.uint64), listed.column("n").to_numpy()
    n_train = int(counts[keys == END].sum())
    if END not in keys:
        keys, counts = np.append(keys, END), np.append(counts, 0)
    above = kinds - sum(levels.get(r, (0, 0))[0] for r in range(1, K + 1))
    freed1 = 0.5 * above + sum(levels.get(r, (0, 0))[0] * r * (1 - d1[r - 1]) for r in range(1, K + 1))
    known = _Words(keys, counts, total, kinds, d1, freed1 / total if total else 1.0, n_train, max(1, math.ceil(n_bytes / part_bytes)))
    shipped = ship(known)

    # counting pass
    frequent = max(HOT * total, 2)
    cells = work.mapInArrow(_sender(shipped, order), CELLS)
    found = stored(cells.groupBy("part").applyInArrow(_counter(shipped, order, frequent), FOUND))
    added = stored(found.where(F.col("kind") == ASK).groupBy("part").applyInArrow(_adder(shipped, order, frequent), FOUND))
    both = found.unionByName(added)
    hist = {(r.a, r.b): int(r.x) for r in both.where(F.col("kind") == HIST).groupBy("a", "b").agg(F.sum("x").alias("x")).collect()}
    disc = [None, d1, *(discounts({r: hist.get((k, r), 0) for r in range(1, K + 2)}) for k in range(2, order + 1))]
    freed, mass = np.zeros(known.size), np.zeros(known.size)
    for r in both.where(F.col("kind") == WORD).groupBy("a", "b").agg(F.sum("x").alias("x")).toArrow().to_pylist():
        if r["b"] == K + 2:
            mass[r["a"]] += r["x"]
        else:
            freed[r["a"]] += r["x"] * (0.5 if r["b"] == K + 1 else r["b"] * (1 - disc[2][r["b"] - 1]))
    grams = both.where(F.col("kind") == GRAM).select("a", "b", "x").toArrow()
    name, c = grams.column("a").to_numpy().view(np.uint64), grams.column("x").to_numpy().astype(np.int64)
    by = np.argsort(name)
    value = np.log10(reduced(c[by], disc[order]) / grams.column("b").to_numpy()[by]) if len(by) else np.empty(0)

    # scoring pass
    cells = work.mapInArrow(_sender(shipped, order, ship((name[by], value))), CELLS)
    extra = both.where(F.col("kind").isin(MASS, TOTALS)).select("part", "kind", "block", "body")
    sums = cells.unionByName(extra).groupBy("part").applyInArrow(_scorer(shipped, order, disc, ship((freed, mass))), "block long, whole boolean, body binary")
    rows = sums.groupBy("block").applyInArrow(_gather, "id long, n_tokens long, n_known long, base double, x double")
    return rows.select(
        F.when(F.col("id") != missing, F.col("id")).alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"),
        F.col("x").alias("score"),
    )


def _count_words(batches):
    """Words of the training texts and their counts, added up in the task; under START: bytes of all texts."""
    held: list = []

    def add():
        keys, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inv, np.concatenate([n for _, n in held])).astype(np.int64)

    size = 0
    for _, _, train, texts in _blocks(batches):
        size += sum(map(len, texts)) + len(texts)
        _, w, d = tokens(texts)
        held.append(np.unique(w[train[d]], return_counts=True))
        if sum(len(k) for k, _ in held) > 4_000_000:
            held = [add()]
            if len(held[0][0]) > 2_000_000:
                yield from _rows(*held.pop())
    held.append((np.array([START]), np.array([size])))
    yield from _rows(*add())


def _rows(keys: np.ndarray, n: np.ndarray):
    for a in range(0, len(keys), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 18)].view(np.int64)), pa.array(n[a : a + (1 << 18)])], names=["w", "n"])
