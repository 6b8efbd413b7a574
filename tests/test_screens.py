"""Screens of a desktop: few runs are told apart whatever the pixels, areas of one grey like a flood, images as bytes."""

import numpy as np

from veilframe.operators import screens, shapes
from veilframe.plans import layouts


def test_few_runs_of_a_restless_desktop(spark, monkeypatch, tmp_path):
    """Before, each pixel of a ground of changing greys was a run to be joined with those around it (74,613 of them here)."""
    spark.createDataFrame([(7,)], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    row = layouts._desktops(spark, str(tmp_path)).first()
    a = np.frombuffer(bytes(row.grey), np.uint8).reshape(row.height, row.width)
    assert a[0, :4].tolist() == [40, 41, 42, 40] and a[119].tolist() == [255] * 480 and a[0, 157:160].tolist() == [250] * 3 and a[239, 287:290].tolist() == [245] * 3
    joined, plain = [], shapes._joined
    monkeypatch.setattr(shapes, "_joined", lambda n, *links: joined.append(n) or plain(n, *links))
    assert len(screens.screens_of(a)) == 4 and 0 < sum(joined) < 2000, sum(joined)


def side(a, x):
    """Box (x, width, height) of the area of one grey that holds the middle of column x."""
    todo = [(a.shape[0] // 2, x)]
    seen = set(todo)
    while todo:
        v, u = todo.pop()
        for p in ((v - 1, u), (v + 1, u), (v, u - 1), (v, u + 1)):
            if p not in seen and 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and a[p] == a[v, u]:
                seen.add(p)
                todo.append(p)
    ys, xs = [p[0] for p in seen], [p[1] for p in seen]
    return min(xs), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1


def test_dead_space_like_a_flood(monkeypatch):
    monkeypatch.setattr(screens, "DEAD_WIDTH", 3)
    rng, found = np.random.default_rng(4), 0
    for k in range(300):
        a = rng.integers(0, 1 + k % 3, (int(rng.integers(2, 9)), int(rng.integers(3, 14)))).astype(np.uint8)
        a[:, : int(rng.integers(0, 8))] = 1
        a[rng.random(a.shape) < 0.1] = 9
        left, right = 0, a.shape[1] - 1
        x, w, h = side(a, 1)
        left = w if w > 3 and h == len(a) else left
        x, w, h = side(a, a.shape[1] - 1)
        right = x if w > 3 and h == len(a) else right
        assert screens.dead_space(a) == (left, right), a
        found += (left, right) != (0, a.shape[1] - 1)
    assert found > 50


def test_bytes_like_arrays(spark):
    a = np.full((120, 300), 40, np.uint8) + np.arange(300, dtype=np.uint8) % 3
    a[:, 140:143] = 250
    rows = [("m", 1, a.reshape(-1), 300, 120), ("m", 2, None, 3, 3), ("m", 3, [], 0, 0), ("m", 4, [1], 2, 2), (None, 5, [9], 1, 1)]
    kinds = {"array<int>": lambda g: [int(v) for v in g], "binary": lambda g: bytearray(bytes(list(g)))}
    got = [sorted(map(str, screens.screens(spark.createDataFrame([(m, f, None if g is None else make(g), w, h) for m, f, g, w, h in rows], f"movie_url string, frameset long, grey {kind}, width int, height int")).collect())) for kind, make in kinds.items()]
    assert got[0] == got[1] and len(got[0]) == 3
