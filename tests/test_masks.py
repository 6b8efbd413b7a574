"""Counts against people's marks and boxes of common components, on the smallest tables, against cells in plain Python."""

import numpy as np
import pytest

from veilframe.operators import shapes
from veilframe.plans import areas
from veilframe.sources import tables

SMALL = "/root/testdata/sf0.001"


def cells(rects, width, height):
    """Lower edges of the strips between all edges, and for each rectangle the strips (x, y) that it covers."""
    xs = sorted({0, width} | {v for x, _, w, _ in rects for v in (x, x + w + 1) if 0 < v < width})
    ys = sorted({0, height} | {v for _, y, _, h in rects for v in (y, y + h + 1) if 0 < v < height})
    within = [{(i, j) for i, a in enumerate(xs[:-1]) if x <= a <= x + w for j, b in enumerate(ys[:-1]) if y <= b <= y + h} for x, y, w, h in rects]
    return xs, ys, within


def flood(start, free, steps):
    seen, todo = set(start), list(start)
    while todo:
        i, j = todo.pop()
        for a, b in steps:
            n = (i + a, j + b)
            if n in free and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def outer(on, nx, ny):
    """Corners of the components of cells that the outside touches."""
    blank = {(i, j) for i in range(-1, nx + 1) for j in range(-1, ny + 1)} - on
    outside = flood([(-1, -1)], blank, FOUR)
    left, out = set(on), []
    while left:
        one = flood([next(iter(left))], left, EIGHT)
        left -= one
        if any((i + a, j + b) in outside for i, j in one for a, b in FOUR):
            out.append((min(i for i, _ in one), min(j for _, j in one), max(i for i, _ in one), max(j for _, j in one)))
    return out


def by_frame(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault((r.movie_url, r.frameset), []).append(r)
    return out


def rect(r):
    return (r.x, r.y, r.w, r.h)


def counts(rows, width=1920, height=1080):
    placed = [r for r in rows if r.x is not None]
    xs, ys, within = cells([rect(r) for r in placed], width, height)
    cover = {id(r): c for r, c in zip(placed, within, strict=True)}
    size = lambda on: sum((xs[i + 1] - xs[i]) * (ys[j + 1] - ys[j]) for i, j in on)
    every = {(i, j) for i in range(len(xs) - 1) for j in range(len(ys) - 1)}
    of = lambda kind: sorted((r for r in placed if r.kind == kind), key=lambda r: r.ord)
    found: set = set()
    for r in of("found"):
        found = found - cover[id(r)] if r.polarity == "negative" else found | cover[id(r)]
    kinds = {r.kind for r in rows}
    want = set() if "expected" in kinds else set(found)
    for r in of("expected") + of("desired"):
        want |= cover[id(r)]
    for r in of("unwanted"):
        want -= cover[id(r)]
    want = found if "pass" in kinds else every - found if "fail" in kinds else want
    lost = want - found
    missed = sum((a, b) in lost and (c, d) in lost for a, b, c, d in outer(want, len(xs) - 1, len(ys) - 1))
    return size(want), width * height - size(want), size(found - want), size(lost), missed


def test_counts_against_marks(spark):
    marks = by_frame(areas._marks(spark, SMALL))
    got = {(r.movie_url, r.frameset): (r.t_pos, r.t_neg, r.f_pos, r.f_neg, r.missed) for r in areas.agg8_manual(spark, SMALL).collect()}
    assert got == {k: counts(v) for k, v in marks.items()} and any(v[4] for v in got.values())


def test_counts_against_a_standard(spark):
    m = tables.matches(spark, SMALL).where("job_id <> 'job_2'")
    rows = by_frame(m.selectExpr("movie_url", "frameset", "if(job_id = 'job_0', 'found', 'expected') kind", "uid ord", "'positive' polarity", "x", "y", "w", "h"))
    got = {(r.movie_url, r.frameset): (r.t_pos, r.t_neg, r.f_pos, r.f_neg, r.missed) for r in areas.agg3_missed(spark, SMALL).collect()}
    assert got == {k: counts(v) for k, v in rows.items()} and any(v[4] for v in got.values())


def test_boxes_of_what_all_cover(spark):
    m = tables.matches(spark, SMALL).selectExpr("movie_url", "frameset", "job_id", "x", "y", "w * 12 w", "h * 15 h")
    want = []
    for k, rows in by_frame(m).items():
        xs, ys, within = cells([rect(r) for r in rows], 2000, 4000)
        by = [set().union(*(c for r, c in zip(rows, within, strict=True) if r.job_id == j)) for j in ("job_0", "job_1", "job_2")]
        if all(any(r.job_id == j for r in rows) for j in ("job_0", "job_1", "job_2")):
            want += [(*k, xs[a], ys[b], xs[c + 1] - xs[a], ys[d + 1] - ys[b]) for a, b, c, d in outer(set.intersection(*by), len(xs) - 1, len(ys) - 1)]
    assert want and sorted(tuple(r) for r in areas.set4_components(spark, SMALL).collect()) == sorted(want)


@pytest.mark.parametrize("few", [0, 64])
def test_outer_components_of_random_masks(few, monkeypatch):
    """With rings around spots, so that some are shut in; both with the comparison of boxes and without."""
    monkeypatch.setattr(shapes, "FEW", few)
    rng = np.random.default_rng(few)
    for n in range(300):
        mask = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.choice([0.2, 0.5, 0.8])
        if n % 3 == 0:
            mask = np.zeros((9, 9), bool)
            mask[1:8, 1:8] = True
            mask[2:7, 2:7] = rng.random((5, 5)) < 0.3
        on = {(int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)}
        assert sorted(shapes.outer_components(mask)) == sorted(outer(on, mask.shape[1], mask.shape[0]))
