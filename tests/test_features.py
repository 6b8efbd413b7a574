"""Corners and descriptors beside loops; the Hamming join beside all pairs."""

import random

import numpy as np
import pytest

from veilframe.operators import features


def plain_corners(a, threshold):
    score = np.zeros(a.shape, int)
    for y in range(3, a.shape[0] - 3):
        for x in range(3, a.shape[1] - 3):
            for sign in (1, -1):
                over = [max(0, sign * (int(a[y + dy, x + dx]) - int(a[y, x])) - threshold) for dx, dy in features.CIRCLE]
                if any(all(over[(k + j) % 16] for j in range(9)) for k in range(16)):
                    score[y, x] = max(score[y, x], sum(over))
    out = []
    for y in range(3, a.shape[0] - 3):
        for x in range(3, a.shape[1] - 3):
            near = [(score[v, u], (v, u)) for v in (y - 1, y, y + 1) for u in (x - 1, x, x + 1) if (v, u) != (y, x)]
            if score[y, x] and all(score[y, x] > s if at < (y, x) else score[y, x] >= s for s, at in near):
                out.append((x, y, score[y, x]))
    return out


def test_corners_like_loops():
    rng = np.random.default_rng(3)
    a = np.kron(rng.integers(0, 256, (7, 9)), np.ones((5, 5), int)).astype(np.uint8)
    for t in (10, 60):
        assert list(map(tuple, features.corners(a, t).tolist())) == plain_corners(a, t)
    assert features.corners(a, 10).size and not features.corners(np.full((20, 20), 5, np.uint8)).size and not features.corners(a[:5]).size


def test_descriptors_follow_the_image():
    rng = np.random.default_rng(5)
    a = np.kron(rng.integers(0, 256, (20, 20)), np.ones((6, 6), int)).astype(np.uint8)
    one = {f[:2]: f[4:] for f in features.described(a)}
    moved = {(x - 7, y - 4): d for x, y, _, _, *d in features.described(np.pad(a, ((4, 9), (7, 3)), mode="edge"))}
    both = [k for k in one if k in moved and 30 < k[0] < 90 and 30 < k[1] < 90]
    assert len(both) > 10 and all(list(one[k]) == moved[k] for k in both)
    turned = {(y, 119 - x): d for x, y, _, _, *d in features.described(np.rot90(a, -1).copy())}  # back to where they were
    bits = lambda p, q: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(p, q))
    close = [bits(one[k], turned[k]) for k in one if k in turned]
    assert len(close) > 10 and np.median(close) < 40


@pytest.mark.parametrize("radius", [0, 3, 15, 40])
def test_every_pair_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(256) for _ in range(12)]
    near = lambda d: d ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(0, min(60, 2 * radius + 3))))
    left, right = [(k, near(base[k % 12])) for k in range(60)] + [(90, base[0]), (91, base[0])], [(k, near(base[k % 12])) for k in range(60)] + [(80, base[0])] * 2
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    words = lambda d: [signed(d >> s & (2**64 - 1)) for s in (192, 128, 64, 0)]
    schema = "id int, d0 long, d1 long, d2 long, d3 long"
    a, b = (spark.createDataFrame([(i, *words(d)) for i, d in rows] + [(-1, None, 1, 2, 3)], schema).withColumn("k", features.F.lit(1)) for rows in (left, right))
    got = sorted((r.id, r.r_id, r.distance) for r in features.near_descriptors(a, b, radius).collect())
    assert got == sorted((i, j, (p ^ q).bit_count()) for i, p in left for j, q in right if (p ^ q).bit_count() <= radius) and got
    assert "CartesianProduct" not in features.near_descriptors(a, b, radius)._jdf.queryExecution().executedPlan().toString()
    assert features.near_descriptors(a.limit(0), b, radius).count() == 0


def test_images_as_rows(spark):
    rng = np.random.default_rng(6)
    a = np.kron(rng.integers(0, 256, (12, 12)), np.ones((6, 6), int)).astype(np.uint8)
    df = spark.createDataFrame([(1, a.reshape(-1).tolist(), 72, 72), (2, None, 3, 3), (3, [1], 3, 3)], "image long, grey array<int>, width int, height int")
    rows = features.features(df, ["image"], most=7).orderBy("n").collect()
    assert [tuple(r)[2:] for r in rows] == features.described(a, 20, 7) and [r.n for r in rows] == list(range(7))
    box = features.feature_boxes(features.features(df, ["image"]), ["image"]).collect()
    assert [(b.image, b.x1 <= b.x2, b.y1 <= b.y2) for b in box] == [(1, True, True)]


def test_descriptors_of_small_numbers(spark):
    """Words whose upper bits are 0 meet by the bits that tell them apart: few pairs are compared, none is lost."""
    rng = np.random.default_rng(3)
    base = [[int(v) for v in rng.integers(0, 1 << 20, 4)] for _ in range(40)]
    rows = [(k, *[v ^ (1 << int(b) if rng.random() < 0.7 else 0) for v, b in zip(base[k % 40], rng.integers(0, 20, 4))]) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, d0 long, d1 long, d2 long, d3 long")
    for radius in (0, 5, 12, 25):
        want = {(a[0], b[0], d) for a in rows for b in rows if (d := sum((x ^ y).bit_count() for x, y in zip(a[1:], b[1:]))) <= radius}
        got = [(r.id, r.r_id, r.distance) for r in features.near_descriptors(df, df, radius).collect()]
        assert len(got) == len(want) and set(got) == want
    masks = features._parts(df.select(*features.NAMES), 14)
    used = [sum(m[w].bit_count() for m in masks) for w in range(4)]
    assert used == [20] * 4 and max(sum(v.bit_count() for v in m) for m in masks) <= 6
    assert features._parts(df.limit(0).select(*features.NAMES), 14) == [] and features.near_descriptors(df, df.limit(0), 12).count() == 0
