"""Templates beside direct sums."""

import resource

import numpy as np
import pytest

from veilframe.operators import images, templates


def direct(image, template):
    h, w = template.shape
    out = np.zeros((image.shape[0] - h + 1, image.shape[1] - w + 1))
    t = template - template.mean()
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            v = image[y : y + h, x : x + w] - image[y : y + h, x : x + w].mean()
            norm = np.sqrt((v * v).sum() * (t * t).sum())
            out[y, x] = (v * t).sum() / norm if norm > 1e-9 else 0.0
    return out


@pytest.mark.parametrize("shape, size", [((20, 31), (5, 7)), ((16, 16), (16, 16)), ((9, 40), (1, 3)), ((13, 11), (12, 2))])
def test_correlation_is_the_direct_sum(shape, size):
    rng = np.random.default_rng(sum(shape))
    a = rng.integers(0, 256, shape, dtype=np.uint8)
    a[:4] = 255  # flat windows
    t = rng.integers(0, 256, size, dtype=np.uint8)
    assert np.abs(templates.correlation(a, t) - direct(a.astype(float), t.astype(float))).max() < 1e-9
    assert not templates.correlation(a, np.full(size, 7, np.uint8)).any()
    assert templates.correlation(a, np.zeros((50, 50), np.uint8)).size == 0


def test_resized_keeps_areas():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (12, 20), dtype=np.uint8)
    assert (templates.resized(a, 20) == a).all()
    half = a.reshape(6, 2, 10, 2).astype(float).mean((1, 3))
    assert np.abs(templates.resized(a, 10) - half).max() <= 0.5
    assert templates.resized(a, 25).shape == (15, 25) and (templates.resized(np.full((8, 8), 9, np.uint8), 13) == 9).all()
    assert templates.resized(a, 0).size == 0


def frame(rng, template, places, shape=(60, 90)):
    a = rng.integers(0, 60, shape, dtype=np.uint8)
    for x, y in places:
        a[y : y + template.shape[0], x : x + template.shape[1]] = template
    return a


def tables(spark, frames, specs):
    f = spark.createDataFrame([("m", k, k, None if a is None else a.reshape(-1).tolist(), *((9, 9) if a is None else a.shape[::-1])) for k, a in enumerate(frames)], "movie_url string, frameset long, place long, grey array<int>, width int, height int")
    t = spark.createDataFrame([(i, a.reshape(-1).tolist(), *a.shape[::-1], s, p, m) for i, a, s, p, m in specs], "anchor_id string, grey array<int>, width int, height int, scale string, percent string, multiple boolean")
    return f, t


def test_matches_at_scales_and_several(spark):
    rng = np.random.default_rng(4)
    t = rng.integers(0, 256, (10, 14), dtype=np.uint8)
    once, thrice, none = frame(rng, t, [(30, 20)]), frame(rng, t, [(5, 5), (40, 30), (70, 8)]), frame(rng, t, [])
    double = frame(rng, np.kron(t, np.ones((2, 2), np.uint8)), [(20, 16)])
    f, s = tables(spark, [once, thrice, none, double, None], [("one", t, "1:1", "95", False), ("all", t, None, "0.95", True), ("wide", t, "+/-50/10", "0.9", False), ("flat", np.full((3, 3), 5, np.uint8), None, "x", True)])
    got: dict = {}
    for r in templates.template_matches(f, s).collect():
        got.setdefault((r.anchor_id, r.frameset), []).append((r.n, r.x, r.y, r.scale))
    assert got["one", 0] == [(0, 30, 20, 1.0)] and len(got["one", 1]) == 1 and ("one", 2) not in got
    assert sorted(x[1:3] for x in got["all", 1]) == [(5, 5), (40, 30), (70, 8)] and {x[0] for x in got["all", 1]} == {0, 1, 2}
    assert got["wide", 0] == [(0, 30, 20, 1.0)] and got["wide", 3] == [(0, 20, 16, 0.5)]
    assert got["flat", 2] == [(0, 0, 0, 1.0)]
    assert templates.template_matches(f.limit(0), s).count() == 0 and templates.template_matches(f, s.limit(0)).count() == 0


def test_adaptive_scales_like_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    t = rng.integers(0, 256, (6, 8), dtype=np.uint8)
    big = np.kron(t, np.ones((2, 2), np.uint8))
    frames = [frame(rng, big if k % 4 else t, [(10 + 2 * k, 10)], (40, 60)) for k in range(14)]
    f, s = tables(spark, frames, [("a", t, "+/-50/10", "0.95", False)])
    want, counts, ladder = [], {}, list(np.round(np.linspace(0.5, 1.5, 11)[::-1], 6))
    for k, a in enumerate(frames):
        for x, y, scale, _ in templates.scan(a, t, ladder, 0.95):
            want.append((k, x, y, scale))
            counts[scale] = counts.get(scale, 0) + 1
        ladder = next(([c] for c, n in counts.items() if n >= 5), ladder)
    two = f.unionByName(f.selectExpr("'n' movie_url", "frameset", "place", "grey", "width", "height").where("place < 5"))
    got = templates.template_matches(two, s, adaptive=True).collect()
    assert sorted((r.frameset, r.x, r.y, r.scale) for r in got if r.movie_url == "m") == want and len(want) < 14
    assert len([r for r in got if r.movie_url == "n"]) == 5
    assert templates.template_matches(f, s).count() == 14


def test_a_whole_frame_in_bounded_memory():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (1080, 1920), dtype=np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert templates.best_match(a, a[500:620, 700:900].copy(), [1.0])[1:] == (700, 500, 1.0)
    images._blurred(a, "blur_21x21")
    images._blurred(a[:200], "blur_median")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


@pytest.mark.parametrize("name", ["t1_template", "t1c_adaptive"])
def test_queries_on_given_tables(spark, name):
    """Each registered match is the first best window of its image by direct sums, and is above the threshold."""
    from veilframe.plans import layouts
    from veilframe.plans.registry import PLAIN

    data = "/root/testdata/sf0.001"
    f, s = layouts._template_frames(spark, data), layouts._templates(spark, data)
    pictures = {(r.movie_url, r.frameset): np.array(r.grey, float).reshape(r.height, r.width) for r in f.collect()}
    cut = {r.anchor_id: np.array(r.grey, float).reshape(r.height, r.width) for r in s.collect()}
    got = {(r.movie_url, r.frameset, r.anchor_id): (r.x, r.y) for r in PLAIN[name](spark, data).where("n = 0").collect()}
    want = {}
    for key, a in pictures.items():
        for i, t in cut.items():
            r = direct(a, t).round(9)
            if r.max() > 0.7:
                want[*key, i] = (int(r.argmax() % r.shape[1]), int(r.argmax() // r.shape[1]))
    assert got == want and got
