"""Features of images: corners with binary descriptors, their boxes, and pairs of descriptors within a Hamming distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.grouped import each_image
from veilframe.operators.templates import window_sums
from veilframe.sources.shared import stored

#: The circle of 16 pixels around a corner, clockwise from above: made by rule from its radius of 3.
CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]
#: Pixels in a row of the circle that have to differ; reach of descriptors; their bits and words of 64.
ARC, REACH, BITS, WORDS = 9, 15, 256, 4
#: Turns of the pattern that a corner's direction is rounded to.
TURNS = 30
NAMES = [f"d{k}" for k in range(WORDS)]


def _pattern() -> np.ndarray:
    """Pairs of places within the reach, drawn once from a seeded generator: x1, y1, x2, y2."""
    rng = np.random.default_rng(20)
    return np.clip(rng.normal(0, REACH / 2.5, (BITS, 4)), -REACH * 0.7, REACH * 0.7)


def corners(a: np.ndarray, threshold: int = 20) -> np.ndarray:
    """(x, y, response) of the pixels with ARC neighbours in a row on their circle that are all lighter, or all darker, by more than the
    threshold. response: the sum of what these differences (of the lighter, or of the darker ones) have over the threshold;
    of touching corners the one with the largest counts, of equal ones the first in reading order."""
    if min(a.shape) < 7:
        return np.zeros((0, 3), np.int64)
    v = a.astype(np.int64)
    middle = v[3:-3, 3:-3]
    around = np.stack([v[3 + y : v.shape[0] - 3 + y, 3 + x : v.shape[1] - 3 + x] - middle for x, y in CIRCLE])
    best = np.zeros(middle.shape, np.int64)
    for side in (around, -around):
        over = np.maximum(side - threshold, 0)
        on = over > 0
        twice = np.concatenate((on, on[: ARC - 1]))
        arc = np.zeros(middle.shape, bool)
        for k in range(16):
            arc |= twice[k : k + ARC].all(0)
        best = np.maximum(best, np.where(arc, over.sum(0), 0))
    full = np.pad(best, 1)
    at = lambda dy, dx: full[1 + dy : full.shape[0] - 1 + dy, 1 + dx : full.shape[1] - 1 + dx]
    top = best > 0
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy, dx) != (0, 0):
                top &= (best > at(dy, dx)) if (dy, dx) < (0, 0) else (best >= at(dy, dx))
    y, x = np.nonzero(top)
    return np.stack([x + 3, y + 3, best[y, x]], 1)


def described(a: np.ndarray, threshold: int = 20, most: int = 500) -> list[tuple]:
    """(x, y, response, angle, words) of the `most` strongest corners that are REACH + 2 pixels from the border; by response, then in reading order."""
    edge = REACH + 2
    c = corners(a, threshold)
    c = c[(c[:, 0] >= edge) & (c[:, 1] >= edge) & (c[:, 0] < a.shape[1] - edge) & (c[:, 1] < a.shape[0] - edge)]
    c = c[np.lexsort((c[:, 0], c[:, 1], -c[:, 2]))][:most]
    if not len(c):
        return []
    smooth = np.pad(window_sums(a, 5, 5), 2, mode="edge")
    y, x = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1]
    disc = x * x + y * y <= REACH * REACH
    x, y = x[disc], y[disc]
    patch = a[c[:, 1, None] + y, c[:, 0, None] + x].astype(np.int64)
    angle = np.degrees(np.arctan2((patch * y).sum(1), (patch * x).sum(1))) % 360
    turn = np.rint(angle / 360 * TURNS).astype(int) % TURNS
    p, out = _pattern(), np.zeros((len(c), BITS), bool)
    for t in np.unique(turn):
        s, q = np.sin(2 * np.pi * t / TURNS), np.cos(2 * np.pi * t / TURNS)
        at = [np.rint(v).astype(int) for v in (q * p[:, 0] - s * p[:, 1], s * p[:, 0] + q * p[:, 1], q * p[:, 2] - s * p[:, 3], s * p[:, 2] + q * p[:, 3])]
        own = np.flatnonzero(turn == t)
        cx, cy = c[own, 0, None], c[own, 1, None]
        out[own] = smooth[cy + at[1], cx + at[0]] < smooth[cy + at[3], cx + at[2]]
    words = np.packbits(out, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    return [(int(a), int(b), int(r), round(float(g), 3), *map(int, w)) for (a, b, r), g, w in zip(c.tolist(), angle, words)]


def features(images: DataFrame, keys: list[str], *, threshold: int = 20, most: int = 500) -> DataFrame:
    """(keys, n, x, y, response, angle, d0 ... d3): the strongest corners of each image (keys, grey, width, height), numbered from 0, with their
    direction in degrees and 256 bits. See corners() and described(). `most` is how many an image has at most: the feature itself.

    Null images and those whose pixels aren't width * height have none. Images are looked at one by one.
    """

    def find(r):
        if r["grey"] is not None and len(r["grey"]) and len(r["grey"]) == r["width"] * r["height"]:
            yield from ((n, *f) for n, f in enumerate(described(r["grey"].astype(np.uint8).reshape(r["height"], r["width"]), threshold, most)))

    added = "n int, x int, y int, response int, angle double, " + ", ".join(f"{c} long" for c in NAMES)
    return each_image(images.where("grey is not null").select(*keys, "grey", "width", "height"), keys, find, added)


def feature_boxes(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x1, y1, x2, y2, n): the box around all of an image's corners."""
    return found.groupBy(*keys).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("n"))


def near_descriptors(left: DataFrame, right: DataFrame, radius: int = 15) -> DataFrame:
    """All pairs of a left and a right descriptor (d0 ... d3) that differ in at most `radius` bits: the left columns, the right ones with
    r_ before them, and distance.

    The bits that are not the same in all descriptors are dealt out over radius + 2 parts, those that tell most apart first, so that every part tells
    about as much. Pairs that near agree in two parts at least, so they meet in the hash join of these parts' numbers and values, and of several
    such parts in the first two alone. (Parts of fixed places would put all descriptors of small numbers, whose upper bits are 0, into one group.) Over a radius
    of 20 there are radius + 1 parts and one has to agree. Equal descriptors are put together before the join and
    dealt out again afterwards, so that a descriptor that very many corners have is compared once. Null descriptors are near nothing.
    """
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63")
    spread = left.sparkSession.sparkContext.defaultParallelism  # few bytes, but many keys are made of each
    kinds = lambda df: stored(df.select(*NAMES).where(" and ".join(f"{c} is not null" for c in NAMES)).distinct().repartition(spread))
    a, b = kinds(left), kinds(right)
    need = 2 if radius <= 20 else 1
    masks = _parts(a.unionByName(b), radius + need)
    if not masks:
        return left.crossJoin(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])).withColumn("distance", F.lit(0)).where("false")
    value = lambda m: f"xxhash64({', '.join(f'{c} & {v}L' for c, v in zip(NAMES, m, strict=True))})"
    other = f"transform(sequence(i + 1, {len(masks) - 1}), j -> struct(i, j, xxhash64(h[i], h[j]) as v))" if need == 2 else "array(struct(i, i as j, h[i] as v))"
    keys = f"transform(array(array({', '.join(map(value, masks))})), h -> flatten(transform(sequence(0, {len(masks) - need}), i -> {other})))[0]"
    keyed = lambda df: df.repartition(spread).select("*", F.expr(f"inline({keys})"))
    same = [" and ".join(f"(({c} ^ b_{c}) & {v}L) = 0" for c, v in zip(NAMES, m, strict=True) if v) or "true" for m in masks]
    agree = "array(" + ", ".join(same) + ")"
    first = f"array_position({agree}, true) - 1 = i" + (f" and i + array_position(slice({agree}, i + 2, {len(masks)}), true) = j" if need == 2 else "")
    distance = F.expr(" + ".join(f"bit_count({c} ^ b_{c})" for c in NAMES)).cast("int")
    pairs = keyed(a).join(keyed(b).withColumnsRenamed({c: f"b_{c}" for c in NAMES}), ["i", "j", "v"]).where(distance <= radius).where(first)
    pairs = pairs.select(*NAMES, *[f"b_{c}" for c in NAMES], distance.alias("distance"))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    joined = left.join(pairs, NAMES).join(r.withColumnsRenamed({f"r_{c}": f"b_{c}" for c in NAMES}), [f"b_{c}" for c in NAMES])
    return joined.select(*left.columns, *[F.col(f"b_{c}" if c in NAMES else f"r_{c}").alias(f"r_{c}") for c in right.columns], "distance")


def _parts(kinds: DataFrame, n: int) -> list[tuple[int, ...]]:
    """Masks (a signed number for each word) of n parts of the bits that differ somewhere; none without descriptors. From one row of counts."""
    bits = [(w, k) for w in range(WORDS) for k in range(64)]
    total, *ones = kinds.agg(F.count("*"), *[F.sum(F.expr(f"shiftrightunsigned({NAMES[w]}, {k}) & 1L")) for w, k in bits]).first()
    if not total:
        return []
    rare = {at: min(one, total - one) for at, one in zip(bits, ones, strict=True)}
    masks = [[0] * WORDS for _ in range(n)]
    for at, (w, k) in enumerate(sorted((b for b in bits if rare[b]), key=lambda b: (-rare[b], b))):
        masks[at % n][w] |= 1 << k
    return [tuple(m - (1 << 64) if m >> 63 else m for m in own) for own in masks]
