"""Secret scans: fixed patterns, and a token-efficiency test that exposes random strings."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame

from veilframe.llm.common import map_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the token test: unbroken runs of the characters of base64, hex and URL-safe keys.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
KINDS = ("assign", "access", "hex", "random")
#: Runs are tokenised in pieces of so many characters, so that a very long one costs no more a character.
PIECE = 512
SPLIT = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"

_encodings: dict = {}


def _encoding(ranks: bytes):
    import base64

    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _encodings[key] = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encodings[key]


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    low = t.lower() if not t.isascii() else t.casefold()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
    return out


def is_known(s: str) -> bool:
    """Digests and identifiers: hexadecimal of a digest's length, UUIDs, numbers, and words without digits or inner capitals."""
    s = s.rstrip("=")
    if UUID.fullmatch(s) or len(s) in DIGEST_LENGTHS and HEX_ONLY.fullmatch(s):
        return True
    letters = re.sub(r"[^A-Za-z]", "", s)
    if not letters or not re.search("[0-9]", s):
        return not letters or letters[1:].islower() or letters.isupper() or letters.islower()
    return False


def random_spans(t: str, encoding, taken: list[tuple[int, int, int]], max_ratio: float) -> list[tuple[int, int, int]]:
    """Runs whose characters per token stay below max_ratio, outside of spans already taken."""
    out, i = [], 0
    taken = sorted((x, y) for x, _, y in taken)
    last = list(accumulate((y for _, y in taken), max))  # the furthest end so far
    for m in RUN.finditer(t):
        a, b, s = m.start(), m.end(), m[0]
        while i < len(taken) and taken[i][0] < b:
            i += 1
        if i and last[i - 1] > a or is_known(s):
            continue
        tokens = sum(map(len, encoding.encode_ordinary_batch([s[i : i + PIECE] for i in range(0, len(s), PIECE)], num_threads=1)))
        if len(s) < max_ratio * tokens:
            out.append((a, 3, b))
    return out


def find_secrets(docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = 2.0, keep: list[str] | None = None) -> DataFrame:
    """Add secrets: array of (kind, start, end), code points, end exclusive, by start and then kind as listed in KINDS.

    assign, access and hex are fixed patterns. random: runs of 16 or more key characters, apart from the fixed spans,
    that are no known digest or identifier and have fewer than max_ratio characters per token of the vocabulary (a
    tiktoken file, read by the driver and sent along: its size doesn't depend on the data; a missing one is an error at once).
    Runs longer than PIECE are tokenised piece by piece.

    One pass over whole texts, no shuffle. Null and empty texts have an empty array. Rows are independent, so repeated
    rows get equal results; empty tables stay empty; a column already named secrets is replaced.
    """
    with open(vocabulary, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        encoding = _encoding(shipped.value)

        def scan(texts):
            out = []
            for t in texts:
                base = base_spans(t or "")
                spans = sorted(base + random_spans(t or "", encoding, base, max_ratio))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            return [out]

        return scan

    return map_text(docs, text, "secrets array<struct<kind:string,start:int,end:int>>", start, keep)
