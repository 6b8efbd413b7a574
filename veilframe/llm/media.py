"""Media columns: baseline JPEG written and read in numpy; thumbnails from the DC coefficients alone.

Huffman decoding goes in lockstep: every restart interval of every image of a batch takes its next symbol at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from veilframe.llm.common import map_text

#: Our files' Huffman tables, made by rule: 12 DC sizes of 4 bits; AC sizes 1-8 without a run 4 bits, all others 9.
DC_SYMBOLS = list(range(12))
AC_SHORT = [*range(1, 9)]
AC_LONG = [0x00, 0xF0, 0x09, 0x0A] + [r << 4 | s for r in range(1, 16) for s in range(1, 11)]
#: Texts are coded in groups of about so many bytes; the arrays take some 60 times that.
GROUP = 1 << 19
WIDE = 64


def _dht(kind: int, lengths: dict[int, list[int]]) -> bytes:
    body = bytes([kind]) + bytes(len(lengths.get(n, ())) for n in range(1, 17)) + bytes(x for n in sorted(lengths) for x in lengths[n])
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


TABLES = _dht(0x00, {4: DC_SYMBOLS}) + _dht(0x10, {4: AC_SHORT, 9: AC_LONG})
AC_CODE, AC_LEN = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
AC_CODE[AC_SHORT], AC_LEN[AC_SHORT] = np.arange(8), 4
AC_CODE[AC_LONG], AC_LEN[AC_LONG] = 256 + np.arange(len(AC_LONG)), 9
SIZE = np.array([int(x).bit_length() for x in range(2048)], np.uint64)


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order of the scan."""
    return np.array([x * 8 + y for x, y in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))])


def _shape(blocks: int) -> tuple[int, int]:
    wide = min(blocks, max(WIDE, -(-blocks // 8191)))
    return wide, -(-blocks // wide)


def _header(payload: int, wide: int, high: int) -> bytes:
    note = b"payload=%d" % payload
    return (
        b"\xff\xd8\xff\xfe" + struct.pack(">H", len(note) + 2) + note + b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
        + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", high * 8, wide * 8) + b"\x01\x01\x11\x00"
        + TABLES + b"\xff\xdd\x00\x04\x00\x01" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """Grey baseline JPEGs whose quantised coefficients (all quantisers 1) are the payload's bytes less 128.

    Each payload is 64 bytes a block; blocks fill rows of up to 64 blocks, the last row filled up with zeros; every
    block is a restart interval of its own. The comment marker has the payload's length.
    """
    if not payloads:
        return []
    shapes = [_shape(len(p) // 64) for p in payloads]
    n = np.array([w * h for w, h in shapes])
    ends = np.cumsum(n)
    v = np.zeros((int(ends[-1]), 64), np.int64)
    for p, e, k in zip(payloads, ends, n, strict=True):
        v[e - k : e - k + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int64) - 128
    size = SIZE[np.abs(v)]
    extra = np.where(v < 0, v + (1 << size.astype(np.int64)) - 1, v).astype(np.uint64)
    some = v != 0
    some[:, 0] = True
    k = np.broadcast_to(np.arange(64), v.shape)
    last = np.maximum.accumulate(np.where(some, k, 0), 1)
    run = np.zeros_like(v)
    run[:, 1:] = k[:, 1:] - last[:, :-1] - 1
    symbol = ((run % 16) << 4) | size.astype(np.int64)
    code, length = AC_CODE[symbol], AC_LEN[symbol]
    code[:, 0], length[:, 0] = size[:, 0], 4
    code = (code << size) | extra
    length = length + size
    for z in range(1, 4):  # runs of 16 zeros and more
        far = some & (run >= 16 * z)
        if far.any():
            code[far] |= AC_CODE[0xF0] << length[far]
            length[far] += AC_LEN[0xF0]
    code[~some], length[~some] = 0, 0
    short = np.flatnonzero(last[:, 63] < 63)  # these end with an end-of-block
    at = last[short, 63]
    code[short, at] = (code[short, at] << AC_LEN[0]) | AC_CODE[0]
    length[short, at] += AC_LEN[0]
    length = length.astype(np.int64)
    bits = length.sum(1)
    size_b = -(-bits // 8)
    first = np.cumsum(size_b) - size_b
    pos = (first * 8)[:, None] + np.cumsum(length, 1) - length
    used = length > 0
    code, length, pos = code[used], length[used], pos[used]
    wide = code << (64 - length - (pos & 7)).astype(np.uint64)
    at, reach = pos >> 3, length + (pos & 7)
    total = int(size_b.sum())
    data = np.zeros(total, np.int64)
    for lane in range(8):
        on = reach > 8 * lane
        if not on.any():
            break
        byte = ((wide[on] >> np.uint64(56 - 8 * lane)) & np.uint64(255)).astype(np.float64)
        data += np.bincount(at[on] + lane, byte, total).astype(np.int64)
    data[first + size_b - 1] += (1 << (size_b * 8 - bits)) - 1  # ones fill the last byte
    data = data.astype(np.uint8)
    # 0 after each 255, a restart marker after each block but an image's last
    grow = 1 + (data == 255)
    final = np.zeros(len(size_b), bool)
    final[ends - 1] = True
    tail = np.where(final, 0, 2)
    grow[first + size_b - 1] += tail
    stop = np.cumsum(grow)
    out = np.zeros(int(stop[-1]), np.uint8)
    out[stop - grow] = data
    order = np.arange(len(size_b)) - np.repeat(ends - n, n)
    mark = stop[first + size_b - 1][~final]
    out[mark - 2], out[mark - 1] = 255, 0xD0 + order[~final] % 8
    cut = np.concatenate(([0], stop[(first + size_b - 1)[ends - 1]]))
    return [_header(len(p), *s) + out[a:b].tobytes() + b"\xff\xd9" for p, s, a, b in zip(payloads, shapes, cut[:-1], cut[1:], strict=True)]


def parse(data: bytes) -> dict | None:
    """Markers of a baseline JPEG: dimensions, components, tables, comment, restart interval and the scan's bytes.

    None where data is no baseline JPEG of one scan, where a segment is cut short or where a table is missing.
    """
    try:
        out = _parse(data)
        if out is None:
            return None
        known = {p[0]: p for p in out["parts"]}
        tables = {k for _, dc, ac in out["scan"] for k in (dc, 0x10 | ac)}
        whole = tables <= set(out["huff"]) and all(len(t) == 16 + sum(t[:16]) and sum(n << (15 - i) for i, n in enumerate(t[:16])) <= 65536 for t in out["huff"].values())
        sound = all(1 <= h <= 4 and 1 <= v <= 4 and q in out["quant"] and len(out["quant"][q]) == 64 for _, h, v, q in known.values())
        if not (whole and sound and len(known) == len(out["parts"])):
            return None
        blocks = _units(out)[2] * (1 if len(known) == 1 else sum(h * v for _, h, v, _ in known.values()))
        return out if 2 * blocks <= 8 * len(out["coded"]) else None  # a block takes two codes of a bit at least
    except (struct.error, IndexError, ValueError):
        return None


def _parse(data: bytes) -> dict | None:
    if data is None or data[:2] != b"\xff\xd8":
        return None
    out: dict = {"quant": {}, "huff": {}, "restart": 0, "note": b""}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                body = body[65 + 64 * wide :]
        elif kind == 0xC0:
            out["height"], out["width"], n = struct.unpack_from(">HHB", body, 1)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return None
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xDD:
            (out["restart"],) = struct.unpack(">H", body[:2])
        elif kind == 0xFE:
            out["note"] = body
        elif kind == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = data.rfind(b"\xff\xd9")
            out["coded"] = data[at : end if end >= at else len(data)]
            ok = "parts" in out and {x[0] for x in out["scan"]} == {x[0] for x in out["parts"]} and out["width"] and out["height"]
            return out if ok else None
    return None


def _units(image: dict) -> tuple[int, int, int]:
    """Units of the scan across, down and in all."""
    alone = len(image["parts"]) == 1
    wide = -(-image["width"] // (8 if alone else 8 * max(p[1] for p in image["parts"])))
    high = -(-image["height"] // (8 if alone else 8 * max(p[2] for p in image["parts"])))
    return wide, high, wide * high


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that may come next; bits that are no code lead behind the end."""
    symbols, lengths = np.zeros(65536, np.int64), np.full(65536, 1 << 40, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            a = code << (16 - n)
            symbols[a : a + (1 << (16 - n))], lengths[a : a + (1 << (16 - n))] = table[at], n
            code, at = code + 1, at + 1
        code <<= 1
    return symbols, lengths


class _Bits:
    """Bit positions in one buffer, many at a time."""

    def __init__(self, data: np.ndarray, pos: np.ndarray):
        d = np.concatenate((data, np.full(8, 255, np.uint8))).astype(np.uint32)
        self.words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        self.pos, self.end = pos, len(data) * 8 + 8

    def take(self, who: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = self.pos[who]
        got = (self.words[p >> 3].astype(np.int64) >> (32 - n - (p & 7))) & ((1 << n) - 1)
        self.pos[who] = np.minimum(p + n, self.end)
        return got

    def symbol(self, who: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        p = self.pos[who]
        code = (self.words[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        self.pos[who] = np.minimum(p + table[1][code], self.end)
        return table[0][code]

    def value(self, who: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = self.take(who, size)
        return np.where(x < (1 << np.maximum(size - 1, 0)), x - (1 << size) + 1, x) * (size > 0)


def decode(files: list[bytes]) -> list[dict | None]:
    """Quantised coefficients of the blocks of each component (blocks high, wide, 64; in scan order); None as in parse(), and
    where an interval's codes go on behind its bits."""
    seen = [parse(f) for f in files]
    groups: dict = {}
    for i, p in enumerate(seen):
        if p:
            alike = (tuple(sorted(p["huff"].items())), tuple(p["parts"]), tuple(p["scan"]))
            groups.setdefault(alike, []).append(i)
    for members in groups.values():
        _decode_alike([seen[i] for i in members])
    return [m if m and m["coef"] else None for m in seen]


def _decode_alike(images: list[dict]) -> None:
    one = images[0]
    tables = {k: _lookup(t) for k, t in one["huff"].items()}
    parts = {p[0]: p for p in one["parts"]}
    alone = len(parts) == 1
    hv = {c: (1, 1) if alone else (p[1], p[2]) for c, p in parts.items()}
    raws, starts, stops, counts, owner, offset = [], [], [], [], [], []
    base, blocks = 0, 0
    for i, m in enumerate(images):
        m["wide"], m["high"], units = _units(m)
        raw = np.frombuffer(m["coded"], np.uint8)
        mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) > 1 else np.empty(0, int)
        drop = np.zeros(len(raw), bool)
        drop[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
        drop[mark], drop[mark + 1] = True, True
        kept = np.cumsum(~drop)
        begin = np.concatenate(([0], kept[mark + 1]))
        each = m["restart"] or units
        k = np.minimum(each, units - each * np.arange(-(-units // each)))
        raws.append(raw[~drop])
        edges = np.concatenate((begin, np.full(max(1, len(k) + 1 - len(begin)), len(raws[-1]))))  # intervals that are missing have no bits
        starts.append(base + edges[: len(k)])
        stops.append(base + edges[1 : len(k) + 1])
        counts.append(k)
        owner.append(np.full(len(k), i))
        offset.append(blocks + each * np.arange(len(k)))
        base += len(raws[-1])
        m["first"], m["units"] = blocks, units
        blocks += units
    bits = _Bits(np.concatenate(raws), np.minimum(np.concatenate(starts), base) * 8)
    count, place, stop, owner = np.concatenate(counts), np.concatenate(offset), np.concatenate(stops) * 8, np.concatenate(owner)
    coef = {c: np.zeros((blocks * h * v, 64), np.int16) for c, (h, v) in hv.items()}
    before = {c: np.zeros(len(count), np.int64) for c in hv}
    for step in range(int(count.max())):
        on = np.flatnonzero((count > step) & (bits.pos <= stop))
        if not len(on):
            break
        for c, dc, ac in one["scan"]:
            h, v = hv[c]
            for b in range(h * v):
                row = (place[on] + step) * (h * v) + b
                before[c][on] += bits.value(on, bits.symbol(on, tables[dc]))
                coef[c][row, 0] = before[c][on]
                who, row, k = on, row, np.ones(len(on), np.int64)
                while len(who):
                    s = bits.symbol(who, tables[0x10 | ac])
                    run, size = s >> 4, s & 15
                    x = bits.value(who, size)
                    k = k + run
                    put = (size > 0) & (k < 64)
                    if put.all():
                        coef[c][row, k] = x
                    else:
                        coef[c][row[put], k[put]] = x[put]
                    k = k + 1
                    stay = (k < 64) & (s != 0)
                    if not stay.all():
                        who, row, k = who[stay], row[stay], k[stay]
    short = set(owner[bits.pos > stop].tolist())
    for i, m in enumerate(images):
        m["coef"] = {}
        for c, (h, v) in hv.items() if i not in short else ():
            x = coef[c][m["first"] * h * v : (m["first"] + m["units"]) * h * v]
            x = x.reshape(m["high"], m["wide"], v, h, 64).transpose(0, 2, 1, 3, 4)
            m["coef"][c] = x.reshape(m["high"] * v, m["wide"] * h, 64)


def thumbnail(image: dict) -> np.ndarray:
    """Luminance (0-255) of each 8 x 8 block, from the first component's DC coefficients alone."""
    c, h, v, q = image["parts"][0]
    dc = image["coef"][c][:, :, 0].astype(np.int64) * int(image["quant"][q][0])
    return np.clip(dc // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hexadecimal digits: which of 8 x 8 sampled places are lighter than their mean."""
    high, wide = thumb.shape
    small = thumb[(np.arange(8) * high) // 8][:, (np.arange(8) * wide) // 8]
    return np.packbits(small > small.mean()).tobytes().hex()


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 or 64 * (not data))


def payload(image: dict) -> bytes:
    """The bytes that encode() has stored; of other files: all coefficients of the first component."""
    c = image["parts"][0][0]
    note = image["note"].partition(b"=")[2]
    n = int(note) if note.isdigit() else image["coef"][c].size
    return (image["coef"][c].reshape(-1).astype(np.int64)[:n] + 128).astype(np.uint8).tobytes()


def _in_groups(values: list[bytes], size, work) -> list:
    out, own, held = [], [], 0
    for v in values:
        own.append(v)
        held += size(v)
        if held >= GROUP:
            out += work(own)
            own, held = [], 0
    return out + (work(own) if own else [])


def to_media(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add media (binary: a JPEG that holds the text's padded UTF-8 bytes losslessly as coefficients) and n_bytes.

    Null and empty texts give 64 zero bytes. One pass, no shuffle; equal texts give equal media; empty tables stay
    empty; columns already named media or n_bytes are replaced. A text of over 4 GB doesn't fit in one image.
    """

    def start():
        def run(texts):
            raw = [(t or "").encode() for t in texts]
            return [_in_groups([padded(r) for r in raw], len, encode), [len(r) for r in raw]]

        return run

    return map_text(docs, text, "media binary, n_bytes long", start, keep)


def read_media(df: DataFrame, *, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Add width, height, thumbnail (binary, one luminance byte a block), thumb_hash, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256 of a column of JPEGs.

    Nulls, bytes that are no baseline JPEG of one scan, and files that are cut short or whose header tells of more blocks than
    their bits can hold get nulls (media_bytes and media_sha256 of null: null).
    """
    added = "width int, height int, thumbnail binary, thumb_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"

    def read(files):
        rows = []
        for f, m in zip(files, decode(files), strict=True):
            row = [None] * 7
            if m:
                t, p = thumbnail(m), payload(m)
                row = [m["width"], m["height"], t.tobytes(), thumbnail_hash(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])]
            rows.append([*row, None if f is None else len(f), None if f is None else hashlib.sha256(f).hexdigest()])
        return rows

    def start():
        def run(files):
            rows = _in_groups(files, lambda f: len(f or b""), read)
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(9)]

        return run

    return map_text(df, media, added, start, keep, kind="binary")
