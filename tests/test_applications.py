"""Applications by tones: areas like a flood over pixels, a drawn screen, headers and odd rows."""

import random

import numpy as np

from veilframe.operators.applications import Rules, movie_apps
from veilframe.operators.shapes import Tones

TEXTS = "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int"
IMAGES = "movie_url string, frameset long, grey array<int>, width int, height int"


def flooded(g, x, y, tolerance):
    seen, todo = {(x, y)}, [(x, y)]
    while todo:
        a, b = todo.pop()
        for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
            if 0 <= c < g.shape[1] and 0 <= d < g.shape[0] and (c, d) not in seen and abs(int(g[d, c]) - int(g[b, a])) <= tolerance:
                seen.add((c, d))
                todo.append((c, d))
    return min(a for a, _ in seen), min(b for _, b in seen), max(a for a, _ in seen) + 1, max(b for _, b in seen) + 1


def test_tones_like_a_flood():
    rng = np.random.default_rng(2)
    for tolerance in (0, 5, 40):
        for _ in range(30):
            g = rng.integers(0, 256, (rng.integers(1, 12), rng.integers(1, 12))) // 30 * 30
            t = Tones(g, tolerance)
            assert all(t.box(x, y) == flooded(g, x, y, tolerance) for x in range(g.shape[1]) for y in range(g.shape[0]))
            assert t.box(-1, 0) is None and t.box(0, g.shape[0]) is None


def screen():
    """A window of 200 x 150 with a title of the same width right above it, and a small box elsewhere."""
    g = np.full((400, 600), 250)
    g[130:160, 100:300] = 90
    g[162:312, 100:300] = 170
    g[340:360, 400:440] = 30
    return g


def test_a_drawn_screen(spark):
    g = screen()
    own = [(1, "Title", 110, 138, 50, 12), (2, "Name", 110, 180, 40, 12), (3, "Anna", 200, 184, 40, 12), (4, "City", 110, 230, 40, 12), (5, "ok", 405, 345, 20, 9), (6, "tab", 10, 20, 30, 10), (7, None, 200, 231, 30, 10), (8, "nowhere", None, 3, 4, 5)]
    t = spark.createDataFrame([("m", 1, *r) for r in own] + [("m", 2, *r) for r in own], TEXTS)
    i = spark.createDataFrame([("m", 1, g.reshape(-1).tolist(), 600, 400), ("m", 3, g.reshape(-1).tolist(), 600, 400), ("m", 2, [1, 2], 600, 400)], IMAGES)
    got = [tuple(r) for r in movie_apps(t, i).collect()]
    window = ("m", 1, 0, 100, 130, 300, 312, True, [["Title"], ["Name", "Anna"], ["City", None]])
    assert got == [window]
    low = [tuple(r) for r in movie_apps(t, i, rules=Rules(least_height=20)).collect()]
    assert low == [window]  # the title alone is a single text
    at = lambda x, y: spark.createDataFrame([("m", 1, x, y), ("m", 1, None, y)], "movie_url string, frameset long, x int, y int")
    assert [tuple(r) for r in movie_apps(t, i, at(300, 312)).collect()] == [] and [tuple(r) for r in movie_apps(t, i, at(301, 312)).collect()] == [window]
    assert movie_apps(t.limit(0), i).count() == 0 and movie_apps(t, i.limit(0)).count() == 0


def plain(texts, image, rules):
    """The rules in one loop over pixels and boxes."""
    g = np.array(image, np.int64) if image is not None else None
    area = {}
    for u, _, x, y, w, h in sorted(texts):
        a = [x, y, x + w, y + h]
        if g is not None and a[3] >= rules.tabs_end:
            mid = ((x + x + w) // 2, (y + y + h) // 2)
            for px, py in ((max(x - rules.aside, 0), y), (min(x + w + rules.aside, g.shape[1] - 1), min(y + h, g.shape[0] - 1))):
                if px < g.shape[1] and py < g.shape[0]:
                    f = flooded(g, px, py, rules.tolerance)
                    if f[0] <= mid[0] <= f[2] and f[1] <= mid[1] <= f[3]:
                        a = [min(a[0], f[0]), min(a[1], f[1]), max(a[2], f[2]), max(a[3], f[3])]
            if (a[2] - a[0]) * (a[3] - a[1]) > rules.most_area:
                a = [x, y, x + w, y + h]
        area[u] = a
    holds = lambda a, x, y: a[0] <= x <= a[2] and a[1] <= y <= a[3]
    for u in sorted(area):
        for v in sorted(area):
            a, b = area[u], area[v]
            if a != b and (holds(a, *b[:2]) or holds(a, *b[2:]) or holds(b, *a[:2]) or holds(b, *a[2:])):
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                if w * h > rules.least_overlap:
                    area[u] = area[v] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
    lines: list = []
    for t in sorted(texts, key=lambda t: (t[3], t[0])):
        if not lines or t[3] - lines[-1][0][3] > rules.row_gap:
            lines.append([])
        lines[-1].append(t)
    apps: dict = {}
    for n, line in enumerate(lines):
        for t in sorted(line, key=lambda t: (t[2], t[3], t[0])):
            apps.setdefault(tuple(area[t[0]]), {}).setdefault(n, []).append(t[1])
    out = [[list(k), list(v.values()), False] for k, v in apps.items()]
    for a in out:
        for b in out:
            (p, q), gap = (a[0], b[0]), b[0][1] - a[0][3]
            if a is not b and len(a[1]) == 1 and 0 <= gap <= rules.header_gap and abs(p[2] - p[0] - q[2] + q[0]) <= rules.header_wider and p[3] - p[1] <= rules.header_height:
                b[0], b[1], b[2] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])], a[1] + b[1], True
    keep = [a for a in out if (len(a[1]) > 1 or len(a[1][0]) > 1) and a[0][2] - a[0][0] >= rules.least_width and a[0][3] - a[0][1] >= rules.least_height]
    return [(i, *a[0], a[2], a[1]) for i, a in enumerate(keep)]


def test_random_screens_like_plain_loops(spark):
    rng = random.Random(4)
    rules = Rules(aside=1, tolerance=5, tabs_end=4, most_area=500, least_overlap=3, row_gap=2, header_height=8, header_gap=3, header_wider=6, least_width=4, least_height=3)
    texts, images, want = [], [], {}
    for f in range(40):
        g = [[rng.choice((10, 14, 90)) if rng.random() < 0.2 else 10 + 40 * (x // 12) + 7 * (y // 9) for x in range(40)] for y in range(30)]
        own = [(u, f"t{u}", rng.randrange(0, 38), rng.randrange(0, 29), rng.randrange(1, 9), rng.randrange(1, 5)) for u in range(rng.randrange(1, 12))]
        texts += [("m", f, *t) for t in own]
        if f % 5:
            images.append(("m", f, [v for row in g for v in row], 40, 30))
        want[f] = plain(own, g if f % 5 else None, rules)
    rng.shuffle(texts)
    got: dict = {}
    for r in movie_apps(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(images, IMAGES), rules=rules).collect():
        got.setdefault(r.frameset, []).append(tuple(r)[2:])
    assert {f: sorted(v) for f, v in got.items()} == {f: v for f, v in want.items() if v}
    assert any(a[5] for v in want.values() for a in v)
