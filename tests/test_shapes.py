"""Shapes, erased text, drawn marks and screens beside loops over pixels."""

import numpy as np
import pytest

from veilframe.operators import erase, screens, shapes


def flood(mask, corners):
    seen, out = np.zeros(mask.shape, bool), []
    for y0, x0 in zip(*np.nonzero(mask)):
        if seen[y0, x0]:
            continue
        stack, own = [(y0, x0)], []
        seen[y0, x0] = True
        while stack:
            y, x = stack.pop()
            own.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    v, u = y + dy, x + dx
                    if (corners or not dy * dx) and 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        stack.append((v, u))
        out.append(own)
    return out


@pytest.mark.parametrize("corners", [True, False])
def test_components_like_a_flood(corners):
    rng = np.random.default_rng(1)
    for k in range(40):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice((0.0, 0.3, 0.55, 0.8, 1.0))
        r, want = shapes.Runs(mask, corners), flood(mask, corners)
        assert r.n == len(want)
        boxes = [(min(x for _, x in o), min(y for y, _ in o), max(x for _, x in o) - min(x for _, x in o) + 1, max(y for y, _ in o) - min(y for y, _ in o) + 1, len(o)) for o in want]
        assert [tuple(b) for b in r.boxes().tolist()] == boxes
        other = rng.random(mask.shape) < 0.1
        assert r.holding(other).tolist() == [any(other[p] for p in o) for o in want]
        wanted = rng.random(r.n) < 0.5
        out = np.zeros(mask.shape, bool)
        for yes, o in zip(wanted, want):
            for p in o if yes else ():
                out[p] = True
        assert (r.painted(wanted, mask.shape) == out).all()
    spiral = np.ones((41, 41), bool)
    for k in range(1, 20, 2):
        spiral[k, k - 1 : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = False
    assert shapes.Runs(spiral, corners).n == len(flood(spiral, corners))


def least(a, x, y, fn=min):
    return np.array([[fn(int(a[v, u]) for v in range(max(0, j - y), min(a.shape[0], j + y + 1)) for u in range(max(0, i - x), min(a.shape[1], i + x + 1))) for i in range(a.shape[1])] for j in range(a.shape[0])], np.uint8)


def sobel(a, j, i):
    h, w = a.shape
    at = lambda v, u: int(a[abs(v) if v < h else 2 * h - 2 - v, abs(u) if u < w else 2 * w - 2 - u])
    gx = sum(k * (at(j + d, i + 1) - at(j + d, i - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(j + 1, i + d) - at(j - 1, i + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    return gx, gy


def test_minima_maxima_and_gradients_like_loops():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (11, 17), dtype=np.uint8)
    for x, y in ((0, 0), (1, 0), (2, 2), (5, 1), (13, 0)):
        assert (shapes.eroded(a, x, y) == least(a, x, y)).all() and (shapes.dilated(a, x, y) == least(a, x, y, max)).all()
    twice = least(least(a, 1, 1), 1, 1)
    assert (shapes.eroded(a, 2, 2) == twice).all()
    gx, gy = shapes.gradients(a)
    for j in range(11):
        for i in range(17):
            assert (gx[j, i], gy[j, i]) == sobel(a, j, i)
            assert shapes.strength(a)[j, i] == round((min(255, abs(gx[j, i])) + min(255, abs(gy[j, i]))) / 2)


def test_edges_of_a_box():
    a = np.full((30, 40), 30, np.uint8)
    a[8:20, 10:30] = 220
    e = shapes.edges(a, 50, 150)
    r = shapes.Runs(e)
    assert r.n == 1 and [tuple(b) for b in r.boxes()[:, :4].tolist()] == [(9, 7, 22, 14)] or tuple(r.boxes()[0, :4]) in ((10, 8, 20, 12), (9, 7, 21, 13), (9, 8, 21, 12))
    assert not shapes.edges(a, 5000, 6000).any() and not shapes.edges(np.full((9, 9), 4, np.uint8), 1, 2).any()


def plain_erased(a, reach):
    ground = max(range(32), key=lambda b: ((a // 8 == b).sum(), -b)) * 8 + 4
    first, second = (min, max) if ground <= 127 else (max, min)
    out = least(least(a, 2, 2, first), 2, 2, second)
    s = np.array([[round((min(255, abs(gx)) + min(255, abs(gy))) / 2) for gx, gy in (sobel(a, j, i) for i in range(a.shape[1]))] for j in range(a.shape[0])], np.uint8)
    strong = least(least(s, reach, 0), 0, 1, max) > 100
    strong[:, 0] = strong[:, -1] = False
    for own in flood(strong, False):
        x1, x2, y1, y2 = min(x for _, x in own), max(x for _, x in own), min(y for y, _ in own), max(y for y, _ in own)
        x, y, xe, ye = max(0, x1 - 1), max(0, y1 - 1), min(a.shape[1], x2 + 2), min(a.shape[0], y2 + 2)
        if xe - x < 20 or (xe - x == a.shape[1] and ye - y == a.shape[0]):
            continue
        middle = y + (ye - y) // 2
        grey = int(a[min(middle, a.shape[0] - 1), min(x + (xe - x) // 2, a.shape[1] - 1)])
        if 3 * abs(grey - ground) < 200:
            grey = 255 if ground <= 127 else 0
        thick = max(1, (ye - y) // 4)
        for j in range(middle - thick // 2, middle - thick // 2 + thick):
            for i in range(x, xe + 1):
                if 0 <= j < a.shape[0] and i < a.shape[1]:
                    out[j, i] = grey
    return out


def test_erased_like_loops_over_pixels():
    rng = np.random.default_rng(5)
    for ground in (230, 20):
        a = np.full((40, 60), ground, np.uint8)
        for _ in range(12):  # strokes
            y, x = rng.integers(0, 38), rng.integers(0, 50)
            a[y : y + rng.integers(1, 4), x : x + rng.integers(1, 9)] = 255 - ground
        a[30:32, 5:55] = 255 - ground
        a[12, 3:40] = ground // 2 + 60
        for reach in (5, 13):
            assert (erase.erased_array(a, "eroded", reach=reach) == plain_erased(a, reach)).all()
    assert erase.lines(a, 13) and erase.erased_array(np.zeros((0, 5), np.uint8), "eroded").size == 0


def test_partitions():
    a = np.full((60, 80), 200, np.uint8)
    a[:, 40:] = 60
    a[10:13, 5:30] = 0  # text on the left ground
    a[20:23, 45:70] = 250
    out = erase.erased_array(a, "color_partitioned", keep_lines=False)
    assert set(np.unique(out[:, 5:35])) == {204} and set(np.unique(out[:, 46:75])) == {60}
    assert erase.colour_ranges(a)[-1][0] in (204, 60) and all(low <= grey <= high for grey, low, high in erase.colour_ranges(a))
    corner = np.full((60, 80), 200, np.uint8)
    corner[:30, :40] = 60
    corner[10:12, 10:16] = corner[50:52, 60:66] = 0
    parts = erase.erased_array(corner, "edge_partitioned", keep_lines=False)
    assert (parts[1:28, 1:38] == 60).all() and (parts[35:, 45:] == 204).all()
    enclosed = np.full((60, 80), 200, np.uint8)
    enclosed[20:45, 20:60] = 60
    rim = erase.erased_array(enclosed, "edge_partitioned", keep_lines=False)
    assert set(np.unique(rim)) == {204, 128} and (rim == 128)[18:47, 18:62].sum() == (rim == 128).sum() > 100
    for how in erase.HOW:
        erase.erased_array(np.full((1, 1), 9, np.uint8), how)


def test_regions_of_images(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20, 30), dtype=np.uint8)
    i = spark.createDataFrame([("p", a.reshape(-1).tolist(), 30, 20), ("q", None, 3, 3), ("s", [1, 2], 3, 3), ("t", [7] * 6, 3, 2)], "image string, grey array<int>, width int, height int")
    r = spark.createDataFrame([("p", 1, -3, 4, 20, 9), ("p", 2, 10, 2, 50, 50), ("p", 3, None, 1, 1, 1), ("p", 4, 90, 90, 5, 5), ("q", 1, 0, 0, 2, 2)], "image string, ord int, x int, y int, w int, h int")
    want = a.copy()
    want[4:13, :17] = erase.erased_array(want[4:13, :17].copy(), "eroded")
    want[2:, 10:] = erase.erased_array(want[2:, 10:].copy(), "eroded")
    got = {x.image: x.grey for x in erase.erased(i, r).collect()}
    assert got == {"p": want.reshape(-1).tolist(), "q": None, "s": [1, 2], "t": [7] * 6}
    assert erase.erased(i.limit(0), r).count() == 0
    m = spark.createDataFrame([("p", 1, "oval", 12, 9, 8, 6, None), ("p", 2, "box", 2, 3, 20, 15, 255), ("p", 3, "star", 1, 1, 1, 1, 0), ("p", 4, "oval", 1, None, 1, 1, 0)], "image string, ord int, kind string, a int, b int, c int, d int, colour int")
    drawn = {x.image: x.grey for x in erase.illustrated(i, m, line=4, shade=True, ratio=0.25).collect()}
    out = a.astype(int)
    oval = lambda x, y, e: ((x - 12) / (8 + e)) ** 2 + ((y - 9) / (6 + e)) ** 2 <= 1 + 1e-12
    for step in (1, 2):
        for y in range(20):
            for x in range(30):
                inside = oval(x, y, 0) if step == 1 else 2 <= x <= 20 and 3 <= y <= 15
                out[y, x] = out[y, x] if inside else round(out[y, x] * 0.75)
                ring = oval(x, y, 2) and not oval(x, y, -2) if step == 1 else 0 <= x <= 22 and 1 <= y <= 17 and not (4 <= x <= 18 and 5 <= y <= 13)
                out[y, x] = (128 if step == 1 else 255) if ring else out[y, x]
    assert drawn["p"] == out.reshape(-1).tolist() and drawn["q"] is None


def desktop(spots=(), shape=(300, 900), ground=40):
    a = np.random.default_rng(9).integers(ground - 2, ground + 3, shape).astype(np.uint8)  # an even ground is dead space
    for y1, y2, x1, x2, grey in spots:
        a[y1:y2, x1:x2] = grey
    return a


def test_screens_of_composed_frames(spark):
    assert screens.screens_of(desktop()) == [(0, 0, 899, 300)] or len(screens.screens_of(desktop())) == 1
    two = screens.screens_of(desktop([(0, 300, 450, 452, 255)]))
    assert len(two) == 2 and abs(two[0][2] - 450) <= 8 and two[1][0] == two[0][2] + 1 and {s[1] for s in two} == {0} and {s[3] for s in two} == {300}
    rows = screens.screens_of(desktop([(150, 153, 0, 900, 255), (0, 150, 500, 502, 255)]))
    assert len(rows) == 3 and rows[0][1] == 0 and abs(rows[0][3] - 150) <= 8 and abs(rows[2][1] - 153) <= 8 and rows[2][3] == 300
    near = screens.screens_of(desktop([(0, 300, 100, 102, 255), (0, 300, 600, 602, 255)]))
    assert len(near) == 2 and abs(near[0][2] - 600) <= 8  # the line at 100 is too near for a screen of this height
    rng = np.random.default_rng(1)
    noise = rng.integers(60, 256, (300, 600), dtype=np.uint8)
    dead = np.full((300, 900), 40, np.uint8)
    dead[:, 150:750] = noise
    assert screens.dead_space(dead) == (150, 750)
    bar = desktop([(285, 287, 0, 900, 255)])
    assert 270 < len(screens.without_taskbar(bar, 5)) < 300 and len(screens.without_taskbar(desktop(), 5)) == 300
    f = spark.createDataFrame([("m", 1, desktop([(0, 300, 450, 452, 255)]).reshape(-1).tolist(), 900, 300), ("m", 2, None, 3, 3), ("m", 3, [], 0, 0), ("m", 4, [1], 2, 2), ("m", 5, [9], 1, 1)], "movie_url string, frameset long, grey array<int>, width int, height int")
    got = [tuple(r)[1:] for r in screens.screens(f).orderBy("frameset", "screen").collect()]
    assert [g[0] for g in got] == [1, 1, 5] and [g[2:] for g in got[:2]] == two
    assert screens.screens(f.limit(0)).count() == 0
