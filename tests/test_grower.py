"""Grown areas beside plain versions of their rules."""

import numpy as np
import pytest

from veilframe.operators import grower

BOX = "movie_url string, frameset long, uid long, x int, y int, w int, h int"


def test_over_a_grid(spark):
    """Texts in three columns and five rows of 30 pixels below the area; a second area of the frame has no texts around."""
    areas = [("m", 1, 1, 100, 50, 200, 20), ("m", 1, 2, 700, 50, 90, 20), ("m", 2, 3, 100, 50, 200, 20)]
    texts = [("m", 1, 10 * r + c, 100 + 70 * c, 120 + 30 * r, 40, 12) for r in range(5) for c in range(3)] + [("m", 1, 99, 5, 5, 3, 3), ("m", 1, 98, None, 5, 3, 3), ("m", 2, 97, 120, 200, 30, 10)]
    a, t = spark.createDataFrame(areas, BOX), spark.createDataFrame(texts, BOX)
    got = [tuple(r) for r in grower.grow(a, "capture_grid", "south", 1000, 600, texts=t, threshold=3).collect()]
    # columns' edges are 100 ... 280, rows 120 ... 240; the last bin of each (270, 230) holds its upper end. The step of 30 begins at 120, and
    # the last one, of 20, counts for it: four steps, so that the grid ends at 120 + 5 * 30
    assert got == [("m", 1, 1, 100, 120, 170, 150)]
    tied = grower.grow(a, "capture_grid", "south", 1000, 600, texts=t, threshold=3, tie=True).first()
    merged = grower.grow(a, "capture_grid", "south", 1000, 600, texts=t, threshold=3, merge=True).first()
    assert tuple(tied)[2:] == (1, 100, 70, 170, 150) and tuple(merged)[2:] == (1, 100, 50, 170, 150)
    below = spark.createDataFrame([("m", 1, 5, 100, 400, 200, 20)], BOX)
    assert grower.grow(below, "capture_grid", "north", 1000, 600, texts=t, threshold=3, merge=True).first().h == 170
    assert grower.grow(a, "capture_grid", "east", 1000, 600, texts=t, threshold=3).count() == 0
    assert grower.grow(a.limit(0), "capture_grid", "south", 1000, 600, texts=t).count() == 0 and grower.grow(a, "capture_grid", "south", 1000, 600).count() == 0


def plain(a, area, direction, ranges, build, least, merge):
    x, y, w, h = area
    part = {"north": a[:y, x : x + w], "south": a[y + h :, x : x + w], "east": a[y : y + h, x + w :], "west": a[y : y + h, :x]}[direction]
    if not part.size:
        return []
    mask = np.array([[any(lo <= v <= hi for lo, hi in ranges) for v in row] for row in part.tolist()])

    def spot(seed, diagonal):
        todo, seen = [seed], {seed}
        while todo:
            j, i = todo.pop()
            for dj in (-1, 0, 1):
                for di in (-1, 0, 1):
                    n = (j + dj, i + di)
                    if (diagonal or not dj * di) and 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] == mask[seed] and n not in seen:
                        seen.add(n)
                        todo.append(n)
        return seen

    box = lambda s: (min(i for _, i in s), min(j for j, _ in s), max(i for _, i in s) - min(i for _, i in s) + 1, max(j for j, _ in s) - min(j for j, _ in s) + 1)
    if build == "near_flood":
        seed = {"north": (mask.shape[0] - 1, mask.shape[1] // 2), "south": (0, mask.shape[1] // 2), "east": (mask.shape[0] // 2, 0), "west": (mask.shape[0] // 2, mask.shape[1] - 1)}[direction]
        found = [box(spot(seed, False))]
    else:
        left, spots = {tuple(p) for p in np.argwhere(mask)}, []
        while left:
            s = spot(min(left), True)
            left -= s
            spots.append(box(s) if len(s) >= least else None)
        spots = [s for s in spots if s]
        if build == "contours":
            found = spots if direction == "east" else []
        else:
            far = {"north": lambda: (0, min(s[1] for s in spots), w, y - min(s[1] for s in spots)), "south": lambda: (0, 0, w, max(s[1] + s[3] for s in spots)), "east": lambda: (0, 0, max(s[0] + s[2] for s in spots), h), "west": lambda: (min(s[0] for s in spots), 0, x - min(s[0] for s in spots), h)}
            found = [far[direction]()] if spots else []
    out = []
    for p, q, r, s in found:
        where = {"north": (p + x, q), "south": (p + x, q + y + h), "east": (p + x + w, q + y), "west": (p, q + y)}[direction]
        if merge:
            where = where if direction in ("north", "west") else (x, y)
            r, s = r + w * (direction in ("east", "west")), s + h * (direction in ("north", "south"))
        out.append((*where, r, s))
    return out


@pytest.mark.parametrize("direction", grower.DIRECTIONS)
def test_over_colours(spark, direction):
    rng = np.random.default_rng(8)
    frames = [np.where(rng.random((24, 30)) < 0.6, rng.integers(100, 140, (24, 30)), rng.integers(0, 256, (24, 30))).astype(np.uint8) for _ in range(4)]
    areas = [("m", k, 10 * k + j, *(int(v) for v in (rng.integers(4, 14), rng.integers(4, 12), rng.integers(3, 9), rng.integers(3, 9)))) for k in range(4) for j in range(2)] + [("m", 0, 77, 0, 0, 30, 24)]
    a = spark.createDataFrame(areas + [("m", 1, 78, None, 1, 1, 1)], BOX)
    f = spark.createDataFrame([("m", k, x.reshape(-1).tolist(), 30, 24) for k, x in enumerate(frames)] + [("m", 9, None, 1, 1)], "movie_url string, frameset long, grey array<int>, width int, height int")
    ranges = [(100, 139), (0, 9)]
    for build in grower.BUILDS:
        for merge in (False, True):
            got = grower.grow(a, "color_projection", direction, 30, 24, frames=f, ranges=ranges, build=build, least=3, merge=merge).collect()
            want = [("m", k, u, *b) for _, k, u, *area in areas for b in plain(frames[k], tuple(area), direction, ranges, build, 3, merge)]
            assert sorted(map(tuple, got)) == sorted(want)


def test_to_a_template(spark):
    a = spark.createDataFrame([("m", 1, 1, 10, 10, 20, 5), ("m", 2, 2, 10, 10, 20, 5)], BOX)
    t = spark.createDataFrame([("m", 1, 7, 12, 60, 8, 9), ("m", 2, 8, 500, 500, 5, 5)], BOX)
    assert [tuple(r) for r in grower.grow(a, "template_capture", "south", 100, 100, templates=t).collect()] == [("m", 1, 1, 10, 15, 20, 54)]
    with pytest.raises(ValueError):
        grower.grow(a, "template_capture", "up", 100, 100, templates=t)
