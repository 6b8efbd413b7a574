"""The window detector: features beside loops, the fit beside plain descent, recall on frames it has not seen."""

import numpy as np
import pytest

from veilframe.operators import detector, layout

SPEC = detector.Spec(16, 16, 4, 2, 6, 4)


def plain_vector(a, y0, x0, spec):
    v = np.sqrt(a.astype(float))
    h, w = a.shape
    cells = {}
    for i in range(spec.height // spec.cell):
        for j in range(spec.width // spec.cell):
            hist = [0.0] * spec.directions
            for y in range(y0 + i * spec.cell, y0 + (i + 1) * spec.cell):
                for x in range(x0 + j * spec.cell, x0 + (j + 1) * spec.cell):
                    gy = v[y + 1, x] - v[y - 1, x] if 0 < y < h - 1 else 0.0
                    gx = v[y, x + 1] - v[y, x - 1] if 0 < x < w - 1 else 0.0
                    hist[min(int(np.degrees(np.arctan2(gy, gx)) % 180 / 180 * spec.directions), spec.directions - 1)] += np.hypot(gx, gy)
            cells[i, j] = hist
    out = []
    for i in range(spec.height // spec.cell - spec.block + 1):
        for j in range(spec.width // spec.cell - spec.block + 1):
            part = [x for p in range(spec.block) for q in range(spec.block) for x in cells[i + p, j + q]]
            out += [x / (sum(part) + 1e-5) for x in part]
    return out


def test_windows_like_loops():
    a = np.random.default_rng(1).integers(0, 256, (25, 30), dtype=np.uint8)
    seen = 0
    for y, xs, v in detector.windows(a, SPEC):
        for x, row in zip(xs, v):
            assert np.allclose(row, plain_vector(a, y, x, SPEC)) and len(row) == SPEC.size
            seen += 1
    assert seen == 3 * 4
    assert np.allclose(detector.described(a[:16, :16], SPEC), plain_vector(a[:16, :16], 0, 0, SPEC))
    assert list(detector.windows(a[:10], SPEC)) == [] and len(detector.described(a[:9, :25], SPEC)) == SPEC.size


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(2)
    v = rng.random((60, SPEC.size)) / 30
    label = v[:, 0] + v[:, 5] > 0.034
    m = detector.fitted(v, label, SPEC, steps=3000)
    x = v * np.sqrt(SPEC.size)
    w = m.weights / np.sqrt(SPEC.size)
    weight = np.where(label, 0.5 / label.sum(), 0.5 / (~label).sum())
    slope = x.T @ (weight * (m.probability(v) - label)) + 1e-3 * w
    assert np.abs(slope).max() < 1e-4 and abs((weight * (m.probability(v) - label)).sum()) < 1e-3


def scene(rng, n_marks):
    """Noise with crosses (to find) and rings and bars (to pass over)."""
    a = rng.integers(90, 110, (80, 110)).astype(np.uint8)
    y, x = np.mgrid[:16, :16]
    cross = (abs(x - y) < 2) | (abs(x + y - 15) < 2)
    ring = abs(np.hypot(x - 7.5, y - 7.5) - 6) < 1.2
    boxes, taken = [], []
    for k in range(n_marks + 3):
        for _ in range(100):
            px, py = int(rng.integers(0, 94)), int(rng.integers(0, 64))
            if all(abs(px - u) > 20 or abs(py - v) > 20 for u, v in taken):
                break
        else:
            continue
        taken.append((px, py))
        a[py : py + 16, px : px + 16][cross if k < n_marks else ring] = 230
        if k < n_marks:
            boxes.append((px, py, 16, 16))
    return a, boxes


@pytest.fixture(scope="module")
def scenes():
    rng = np.random.default_rng(7)
    return [scene(rng, 2) for _ in range(40)]


def tables(spark, some, first):
    f = spark.createDataFrame([("m", first + k, a.reshape(-1).tolist(), 110, 80) for k, (a, _) in enumerate(some)] + [("m", None, None, 3, 3), ("m", 9999, [1], 3, 3)], "movie_url string, frameset long, grey array<int>, width int, height int")
    t = spark.createDataFrame([("m", first + k, *b) for k, (_, boxes) in enumerate(some) for b in boxes] + [("m", first, None, 1, 1, 1)], "movie_url string, frameset long, x int, y int, w int, h int")
    return f, t


def test_held_out_recall(spark, scenes):
    frames, truths = tables(spark, scenes[:20], 0)
    spec = detector.Spec(16, 16, 4, 2, 9, 2)
    model = detector.train(frames, truths, spec, rounds=2)
    once = detector.train(frames, truths, spec, rounds=0)
    held, boxes = tables(spark, scenes[20:], 20)
    count = lambda m: detector.detect(held, m).count()
    found = detector.detect(held, model).selectExpr("*", "row_number() over (partition by frameset order by score desc, y, x) + frameset * 10000 uid")
    kept = {(r.frameset, r.uid) for r in layout.suppressed(found).collect()}
    rows = [r for r in found.collect() if (r.frameset, r.uid) in kept]
    near = lambda r, b: r.frameset == b[0] and abs(r.x - b[1]) <= 4 and abs(r.y - b[2]) <= 4
    want = [(20 + k, *b) for k, (_, bs) in enumerate(scenes[20:]) for b in bs]
    recall = sum(any(near(r, b) for r in rows) for b in want) / len(want)
    precision = sum(any(near(r, b) for b in want) for r in rows) / len(rows)
    assert recall > 0.9 and precision > 0.9, (recall, precision)
    assert count(model) <= count(once)  # mistakes that were fed back are gone


def test_odd_tables(spark, scenes):
    frames, truths = tables(spark, scenes[:2], 0)
    none = detector.train(frames, truths.limit(0), SPEC)
    assert detector.detect(frames, none).count() == 0 and detector.detect(frames.limit(0), none).count() == 0
    assert detector.train(frames.limit(0), truths, SPEC).bias == -50.0
    rows = detector.examples(frames, truths, SPEC, 5).collect()
    assert sorted(r.label for r in rows) == [False] * 10 + [True] * 4


def test_images_stay_in_many_tasks(spark, scenes):
    """Detection moves no image, examples and false alarms move each once, into a number of parts that is given."""
    frames, truths = tables(spark, scenes[:6], 0)
    model = detector.Model(SPEC, np.zeros(SPEC.size), 5.0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(detector.detect(frames, model))
    for df in (detector.examples(frames, truths, SPEC, 2), detector.false_alarms(frames, truths, model, (1.0,), 0.9)):
        moved = [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]
        assert sum("REPARTITION_BY_NUM" in x for x in moved) == 1 and len(moved) <= 2, plan(df)  # the other one: boxes


def test_false_alarms_like_plain_rules(spark, scenes):
    frames, truths = tables(spark, scenes[:3], 0)
    model = detector.Model(SPEC, np.zeros(SPEC.size), 5.0)  # takes every window
    got = [tuple(round(v, 9) for v in (r.frameset, *r.v)) for r in detector.false_alarms(frames, truths, model, (1.0,), 0.9).collect()]
    want = []
    for k, (a, boxes) in enumerate(scenes[:3]):
        for y in range(0, a.shape[0] - 15, SPEC.step):
            for x in range(0, a.shape[1] - 15, SPEC.step):
                if not any(max(0, 16 - abs(x - u)) * max(0, 16 - abs(y - v)) > 0.3 * 256 for u, v, _, _ in boxes):
                    want.append(tuple(round(v, 9) for v in (k, *detector.described(a[y : y + 16, x : x + 16], SPEC).tolist())))
    assert sorted(got) == sorted(want) and want


def test_windows_in_bands(monkeypatch):
    a = np.random.default_rng(5).integers(0, 256, (70, 90), dtype=np.uint8)
    whole = [(y, xs.tolist(), v.tolist()) for y, xs, v in detector.windows(a, SPEC)]
    monkeypatch.setattr(detector, "BAND", 1)
    assert [(y, xs.tolist(), v.tolist()) for y, xs, v in detector.windows(a, SPEC)] == whole and len(whole) == 14
