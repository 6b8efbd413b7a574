"""JPEG files that another writer makes: several components, subsampling, no or long restart intervals, and files cut short."""

import random
import struct
import time

import numpy as np
import pytest

from veilframe.llm import media, queries


class Writer:
    """A plain baseline writer with Huffman codes of one length: DC sizes 4 bits, AC symbols 8 bits (all but the last code)."""

    AC = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]

    def __init__(self):
        self.bits = ""

    def number(self, x):
        size = abs(x).bit_length()
        return size, format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    def block(self, zz, before):
        size, extra = self.number(zz[0] - before)
        self.bits += format(size, "04b") + extra
        run, last = 0, max((k for k in range(1, 64) if zz[k]), default=0)
        for k in range(1, last + 1):
            if not zz[k]:
                run += 1
                continue
            while run > 15:
                self.bits += format(self.AC.index(0xF0), "08b")
                run -= 16
            size, extra = self.number(zz[k])
            self.bits += format(self.AC.index(run << 4 | size), "08b") + extra
            run = 0
        if last < 63:
            self.bits += format(0, "08b")

    def flush(self):
        data = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return bytes(int(data[i : i + 8], 2) for i in range(0, len(data), 8)).replace(b"\xff", b"\xff\x00")


def jpeg(width, height, parts, coef, restart=0):
    """parts: (id, h, v); coef: for each id blocks[row][column] of 64 numbers in scan order."""
    table = lambda kind, n, symbols: b"\xff\xc4" + struct.pack(">H", 19 + len(symbols)) + bytes([kind]) + bytes(len(symbols) if i == n else 0 for i in range(1, 17)) + bytes(symbols)
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(range(1, 65)) + b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(parts), 8, height, width, len(parts))
    head += b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in parts) + table(0x00, 4, range(12)) + table(0x10, 8, Writer.AC)
    if restart:
        head += b"\xff\xdd\x00\x04" + struct.pack(">H", restart)
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([i, 0]) for i, _, _ in parts) + b"\x00\x3f\x00"
    alone = len(parts) == 1
    top_h, top_v = (1, 1) if alone else (max(p[1] for p in parts), max(p[2] for p in parts))
    wide, high = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    w, before, out = Writer(), dict.fromkeys([p[0] for p in parts], 0), b""
    for u in range(wide * high):
        if restart and u and u % restart == 0:
            out += w.flush() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            before = dict.fromkeys(before, 0)
        for i, h, v in parts:
            h, v = (1, 1) if alone else (h, v)
            for b in range(h * v):
                zz = coef[i][u // wide * v + b // h][u % wide * h + b % h]
                w.block(zz, before[i])
                before[i] = zz[0]
    return head + out + w.flush() + b"\xff\xd9"


def blocks(rng, high, wide):
    few = lambda: [rng.randrange(-400, 400), *(rng.choice((0, 0, 0, rng.randrange(-90, 90))) for _ in range(63))]
    return [[few() if rng.random() < 0.8 else [rng.randrange(-9, 9)] + [0] * 40 + [5] + [0] * 22 for _ in range(wide)] for _ in range(high)]


CASES = [
    (33, 20, [(1, 1, 1)], {1: (3, 5)}, 0), (33, 20, [(1, 2, 2)], {1: (3, 5)}, 4), (40, 24, [(1, 1, 1), (2, 1, 1), (3, 1, 1)], dict.fromkeys((1, 2, 3), (3, 5)), 0),
    (40, 40, [(1, 2, 2), (2, 1, 1), (3, 1, 1)], {1: (6, 6), 2: (3, 3), 3: (3, 3)}, 0), (40, 40, [(7, 2, 1), (9, 1, 1)], {7: (5, 6), 9: (5, 3)}, 2),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_files_of_another_writer(case):
    width, height, parts, sizes, restart = CASES[case]
    rng = random.Random(case)
    coef = {i: blocks(rng, *size) for i, size in sizes.items()}
    file = jpeg(width, height, parts, coef, restart)
    (got,) = media.decode([file])
    assert (got["width"], got["height"]) == (width, height)
    for i, want in coef.items():
        assert got["coef"][i].tolist() == want
    thumb = media.thumbnail(got)
    first = np.array([[b[0] for b in row] for row in coef[parts[0][0]]])
    assert (thumb == np.clip(first // 8 + 128, 0, 255)).all() and len(media.thumbnail_hash(thumb)) == 16


def test_cut_files_are_no_images():
    rng = random.Random(9)
    coef = {1: blocks(rng, 3, 5)}
    for restart in (0, 1, 4):
        file = jpeg(33, 20, [(1, 1, 1)], coef, restart)
        start = file.index(b"\xff\xda") + 10
        assert media.decode([file])[0] is not None
        for at in [*range(0, start, 7), *range(start, len(file) - 12, 11)]:
            assert media.decode([file[:at], file])[0] is None and media.decode([file, file[:at]])[0] is not None
        flipped = [bytearray(file) for _ in range(30)]
        for f in flipped:
            f[rng.randrange(start, len(file) - 2)] ^= 1 << rng.randrange(8)
        assert len(media.decode([bytes(f) for f in flipped])) == 30


def test_a_header_that_asks_for_more_than_the_file_holds():
    file = jpeg(33, 20, [(1, 1, 1)], {1: blocks(random.Random(1), 3, 5)})
    at = file.index(b"\xff\xc0") + 5
    began = time.time()
    for size in (1600, 65535):
        huge = file[:at] + struct.pack(">HH", size, size) + file[at + 4 :]
        assert media.decode([huge, file])[0] is None
        empty = huge[: huge.index(b"\xff\xda") + 10] + b"\xff\xd9"
        assert media.decode([empty])[0] is None
    assert time.time() - began < 2


def test_query_on_given_texts(spark):
    """The columns of the registered query from the texts alone."""
    import hashlib
    import zlib

    data = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op6_jpeg_media(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw, r = (d.text or "").encode(), got[d.doc_id]
        packed = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(packed), hashlib.sha256(packed).hexdigest(), zlib.crc32(packed[-64:]))
        first = np.frombuffer(packed, np.uint8)[::64].astype(int) - 128
        wide, high = r.width // 8, r.height // 8
        thumb = np.full(wide * high, 128)
        thumb[: len(first)] = first // 8 + 128
        thumb = thumb.reshape(high, wide)
        small = thumb[[i * high // 8 for i in range(8)]][:, [i * wide // 8 for i in range(8)]]
        assert r.feature == f"{r.width}x{r.height}:" + np.packbits(small > small.mean()).tobytes().hex()
        (m,) = media.encode([packed])
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
