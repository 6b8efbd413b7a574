"""Operators that SQL can't express against plain Python, and defined results for odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import boxes, focus, graphs, jobs, layout, masks, pixels, regions, sets, texts
from veilframe.plans import queries as plans
from veilframe.sources import archive
from veilframe.sources import tables as S

DATA = "/root/testdata/sf0.001"
RECTS = "movie_url string, frameset long, job_id string, uid long, x int, y int, w int, h int, polarity string"


def random_rects(n, seed, size=60):
    rng = random.Random(seed)
    return [("m", rng.randrange(4), f"job_{rng.randrange(3)}", i, rng.randrange(-5, size), rng.randrange(-5, size), rng.randrange(0, 25), rng.randrange(0, 25), rng.choice(["positive", "negative", None])) for i in range(n)]


def pixels_of(rect, width, height):
    x, y, w, h = rect
    return {(a, b) for a in range(max(0, x), min(width, x + w + 1)) for b in range(max(0, y), min(height, y + h + 1))}


def outer_boxes(covered, width, height):
    """Boxes of components (8 neighbours) that the outside (4 neighbours) touches, pixel by pixel."""
    outside, stack = set(), [(-1, -1)]
    while stack:
        p = stack.pop()
        if p in outside or p in covered or not (-1 <= p[0] <= width and -1 <= p[1] <= height):
            continue
        outside.add(p)
        stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    out, left = [], set(covered)
    while left:
        stack, own = [next(iter(left))], set()
        while stack:
            p = stack.pop()
            if p in left:
                left.discard(p)
                own.add(p)
                stack += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        if any((a + c, b + d) in outside for a, b in own for c, d in ((1, 0), (-1, 0), (0, 1), (0, -1))):
            xs, ys = [p[0] for p in own], [p[1] for p in own]
            out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return sorted(out)


def test_intersection_boxes(spark):
    rows = random_rects(60, 1)
    got = masks.intersected(spark.createDataFrame(rows, RECTS), ["job_0", "job_1", "job_2"], 64, 64).collect()
    for f in range(4):
        by = [set().union(*[pixels_of(r[4:8], 64, 64) for r in rows if r[1] == f and r[2] == f"job_{k}"]) for k in range(3)]
        assert sorted((r.x, r.y, r.w, r.h) for r in got if r.frameset == f) == outer_boxes(by[0] & by[1] & by[2], 64, 64)
    ring = [("m", 1, j, i, *r, None) for j in ("a", "b") for i, r in enumerate([(5, 5, 20, 2), (5, 23, 20, 2), (5, 5, 2, 20), (23, 5, 2, 20), (12, 12, 3, 3)])]
    got = masks.intersected(spark.createDataFrame(ring, RECTS), ["a", "b"], 64, 64).collect()
    assert [tuple(r[2:]) for r in got] == [(5, 5, 21, 21)]
    assert masks.intersected(spark.createDataFrame(ring, RECTS), ["a", "c"]).count() == 0


def test_score_counts(spark):
    rng = random.Random(2)
    rows = [("m", r[1], rng.choice(["found", "desired", "unwanted"]), r[3], r[8], *r[4:8]) for r in random_rects(50, 3)]
    rows += [("m", 2, "pass", None, None, None, None, None, None), ("m", 3, "fail", None, None, None, None, None, None)]
    rows += [("m", 9, "found", 1, None, 1, 1, 5, 5), ("m", 9, "expected", 2, None, 30, 30, 4, 4), ("m", 9, "expected", 3, None, 1, 1, 9, 9)]
    df = spark.createDataFrame(rows, "movie_url string, frameset long, kind string, ord long, polarity string, x int, y int, w int, h int")
    got = {r.frameset: tuple(r[2:]) for r in masks.score_counts(df.withColumn("extra", F.lit(1)), 64, 64).collect()}
    for f in (0, 1, 2, 3, 9):
        own = sorted((r for r in rows if r[1] == f and r[5] is not None), key=lambda r: r[3])
        found = set()
        for r in own:
            if r[2] == "found":
                found = found - pixels_of(r[5:], 64, 64) if r[4] == "negative" else found | pixels_of(r[5:], 64, 64)
        want = set() if f == 9 else set(found)
        for kind in ("desired", "expected", "unwanted"):
            for r in own:
                if r[2] == kind:
                    want = want - pixels_of(r[5:], 64, 64) if kind == "unwanted" else want | pixels_of(r[5:], 64, 64)
        everything = pixels_of((0, 0, 63, 63), 64, 64)
        want = found if f == 2 else everything - found if f == 3 else want
        lost = want - found
        missed = sum((x, y) in lost and (x + w - 1, y + h - 1) in lost for x, y, w, h in outer_boxes(want, 64, 64))
        assert got[f] == (len(want), 4096 - len(want), len(found - want), len(lost), missed)
    assert masks.score_counts(df.limit(0)).count() == 0


def test_union_area_and_alignment(spark):
    rows = [r[:1] + (r[1] % 2,) + r[2:] for r in random_rects(50, 5)] + [("m", 7, "j", 1, None, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, RECTS)
    got = {r.frameset: r.area for r in boxes.union_area(df).collect()}
    big = lambda r: {(a, b) for a in range(r[4], r[4] + r[6] + 1) for b in range(r[5], r[5] + r[7] + 1)}
    assert got == {f: len(set().union(*[big(r) for r in rows if r[1] == f])) for f in (0, 1)}
    twice = spark.createDataFrame(rows + rows[:3], RECTS)
    for tolerance in (0, 3):
        near = lambda a, b: a[1] == b[1] and a[3] != b[3] and None not in (a[4], b[4]) and min(abs(a[4] - b[4]), abs(a[5] - b[5]), abs(a[4] + a[6] - b[4] - b[6])) <= tolerance
        want = sorted(r[3] for r in rows + rows[:3] if any(near(r, o) for o in rows))
        assert sorted(r.uid for r in boxes.aligned(twice, tolerance).collect()) == want


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5), (4, None), (1, 2)], "src long, dst long")
    got = {(r.src, r.dst): r.distance for r in graphs.closure(edges).collect()}
    assert got == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (3, 4): 1, (1, 3): 2, (2, 1): 2, (2, 4): 2, (3, 2): 2, (1, 1): 3, (2, 2): 3, (3, 3): 3, (1, 4): 3}
    assert graphs.closure(edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        graphs.levels(edges.unionByName(spark.createDataFrame([(9, 1)], "src long, dst long")).withColumn("g", F.lit(1)), ("g",))
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "id long, parent_id long")
    assert {r.root for r in graphs.tops(chain).collect()} == {0} and graphs.subtree(chain, chain.where("id = 0")).count() == 70
    tree = [(1, None, "running", "a", None), (2, 1, "success", "a", None), (3, 1, "running", "b", 5), (4, 3, "failed", "a", None), (5, 3, "created", "a", None), (6, 3, "running", "a", None), (7, None, None, None, None)]
    done = {r.id: r.done for r in graphs.percent_complete(spark.createDataFrame(tree, "id long, parent_id long, status string, operation string, anticipated int"), {"b": 2.0}).collect()}
    assert done == {1: pytest.approx((1 + 2 * 0.2) / 2), 2: 1, 3: 0.2, 4: 1, 5: 0, 6: 0, 7: 0}
    told = spark.createDataFrame([(0.0, 0.0, "running"), (0.0, 0.04, "created"), (0.5, 0.56, "running"), (0.5, 0.54, "running")], "a double, b double, s string")
    assert [r[0] for r in told.select(graphs.worth_telling("a", "b", "s")).collect()] == [0.0, 0.0, 0.56, 0.5]


def test_job_rules(spark):
    j = spark.createDataFrame([(1, None, "2020-01-01"), (2, None, "2020-01-02"), (3, None, "2020-01-03"), (4, 1, "2020-01-09"), (5, None, None)], "id long, parent_id long, created_on string")
    assert sorted(r.id for r in jobs.swept(j, j.where("id = 1"), 2).collect()) == [2, 5]
    assert jobs.swept(j, j.limit(0), 10).count() == 0 and jobs.swept(j.limit(0), j.limit(0), 1).count() == 0
    e = spark.createDataFrame([(1, None, "x", "running"), (2, 1, "x", "success"), (3, 1, "y", "failed"), (4, 2, "y", "failed"), (5, 4, "y", None)], "id long, parent_id long, operation string, status string")
    assert {r.id: r.action for r in jobs.evaluated(e, "y").collect()} == {1: "abort", 2: "abort", 3: "build_child_tasks", 4: "noop", 5: "build_child_tasks"}
    a = spark.createDataFrame([(1, "auto_delete_age", "7days"), (2, "auto_delete_age", "7days"), (1, None, "x")], "job_id long, name string, value string")
    got = sorted((r.job_id, r.name or "", r.value) for r in jobs.preserved(a, spark.createDataFrame([(1,)], "job_id long")).collect())
    assert got == [(1, "", "x"), (1, "auto_delete_age", "never"), (2, "auto_delete_age", "7days")]
    assert archive.rebased(spark.createDataFrame([("a/m1/f",), ("m1",), (None,)], "u string"), "u", spark.createDataFrame([("m1", "n")], "old string, new string")).select("u").collect() == [("a/n/f",), ("m1",), (None,)]


def test_containing(spark):
    rows = spark.createDataFrame([("abcabc", 1), ("", 2), (None, 3), ("xbc", 4)], "t string, k int")
    needles = spark.createDataFrame([("bc",), ("abcabc",), ("",), (None,), ("zz",), ("x",)], "n string")
    assert sorted((r.k, r.n) for r in sets.containing(rows, "t", needles, "n").collect()) == [(1, "abcabc"), (1, "bc"), (4, "bc"), (4, "x")]
    assert sets.containing(rows, "t", needles.limit(0), "n").count() == 0


def brute_assignment(scores):
    from itertools import product

    rows = range(-1, len(scores))
    best = 0
    for path in product(rows, repeat=len(scores[0])):
        used = [r for r in path if r >= 0]
        if used == sorted(set(used)) and all(scores[r][c] > 0 for c, r in enumerate(path) if r >= 0):
            best = max(best, sum(scores[r][c] for c, r in enumerate(path) if r >= 0))
    return best


def test_best_assignment():
    scores = [[0, 0, 0, 117], [98, 0, 0, 0], [224, 0, 0, 0], [0, 85, 0, 0], [0, 0, 0, 81]]
    assert layout.best_assignment(scores) == ([2, 3, -1, 4], 390)
    rng = random.Random(4)
    for _ in range(60):
        n, k = rng.randrange(1, 6), rng.randrange(1, 5)
        table = [[rng.choice([0, 0, rng.randrange(1, 99)]) for _ in range(k)] for _ in range(n)]
        path, total = layout.best_assignment(table)
        used = [r for r in path if r >= 0]
        assert used == sorted(set(used)) and total == sum(table[r][c] for c, r in enumerate(path) if r >= 0) == brute_assignment(table)
    assert layout.best_assignment([]) == ([], 0)


TEXT = "movie_url string, frameset long, uid long, x int, y int, w int, h int"


def test_rows_and_columns(spark):
    rows = [(1, 10, 100, 40, 10), (2, 60, 103, 40, 10), (3, 110, 106, 40, 10), (4, 12, 140, 40, 10), (5, 2000, 101, 10, 10), (6, None, 1, 1, 1)]
    df = spark.createDataFrame([("m", 1, *r) for r in rows], TEXT)
    got = {r.uid: (r.row, r.left_col, r.right_col) for r in layout.rows_and_columns(df).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 2, 2), 3: (3, 3, 3), 4: (4, 1, 1), 5: (5, 5, 5)} or got[3][0] in (1, 3)
    assert got[5][0] == 5 and got[4] == (4, 1, 1) and got[2][0] == 1


def test_bunches_spacing_and_claims(spark):
    df = spark.createDataFrame([("m", 1, i, 0, y, 1, 1) for i, y in enumerate([0, 8, 16, 17, 40, None])], TEXT)
    assert {r.uid: r.bunch for r in layout.bunched(df, 10).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    at = spark.createDataFrame([("m", v) for v in (20, 40, 60, 90, 120, None)], "movie_url string, at int")
    assert [tuple(r) for r in layout.row_spacing(at, ["movie_url"], "at").collect()] == [("m", 0, 120, 20)]
    wanted = spark.createDataFrame([("m", 1, k, f"item{k}", x, 0, "left") for k, x in enumerate([0, 1, 500])], "movie_url string, frameset long, ord int, item string, x int, y int, side string")
    text = spark.createDataFrame([("m", 1, 7, 0, 0, 5, 5), ("m", 1, 8, 30, 40, 5, 5), ("m", 2, 9, 0, 0, 1, 1)], TEXT)
    assert sorted(tuple(r[2:4]) for r in layout.claimed_neighbours(wanted, text).collect()) == [("item0", 7), ("item1", 8)]


def test_suppression(spark):
    rng = random.Random(9)
    rows = [("m", f, i, rng.randrange(50), rng.randrange(50), rng.randrange(5, 30), rng.randrange(5, 30), rng.randrange(9)) for i, f in enumerate([1] * 30 + [2] * 10)]
    got = {r.uid for r in layout.suppressed(spark.createDataFrame(rows, TEXT + ", score int")).collect()}
    want = set()
    for f in (1, 2):
        left = sorted((r for r in rows if r[1] == f), key=lambda r: (-r[7], -r[2]))
        while left:
            k = left.pop(0)
            want.add(k[2])
            share = lambda r: max(0, min(r[3] + r[5], k[3] + k[5]) - max(r[3], k[3]) + 1) * max(0, min(r[4] + r[6], k[4] + k[6]) - max(r[4], k[4]) + 1) / ((r[5] + 1) * (r[6] + 1))
            left = [r for r in left if share(r) <= 0.3]
    assert got == want


def test_hotspots(spark):
    rows = [("m", f, f * 10, 5, 5, 20, 20) for f in range(40)] + [("m", f, f * 10 + 1, 80, 80, 3, 3) for f in range(36)] + [("m", f, f * 10 + 2, 60 + f, 40, 4, 4) for f in (1, 20)]
    df = spark.createDataFrame(rows, TEXT)
    kept = {r.uid for r in focus.without_hotspots(df, 100, 100).collect()}
    assert kept == {r[2] for r in rows if r[3] > 5}  # 40 of 40 is in the top bin, 36 of 40 in the trough below it
    assert focus.without_hotspots(df, 100, 100, least_pixels=10**6).count() == len(rows) and focus.without_hotspots(df.limit(0), 9, 9).count() == 0


def test_pixels(spark):
    p = spark.createDataFrame([("a", 10, 20, 30)] * 5 + [("a", 200, 0, 0)] * 4 + [("a", 12, 21, 29)] * 2 + [("a", None, 0, 0), ("b", 255, 255, 255)], "image string, b int, g int, r int")
    assert sorted(tuple(r) for r in pixels.dominant_colour(p).collect()) == [("a", 12, 20, 28, 7), ("b", 252, 252, 252, 1)]
    groups = {(r.image, r.grp): (r.b, r.g, r.r, r.n) for r in pixels.colour_groups(p).collect()}
    assert groups == {("a", 0): (12, 20, 28, 7), ("a", 1): (204, 4, 4, 4), ("b", 0): (252, 252, 252, 1)}
    grey = [10, 10, 90, 10, 11, 90, 90, 12, 90]
    img = spark.createDataFrame([("i", grey, 3, 3), ("n", None, 3, 3)], "image string, grey array<int>, width int, height int")
    assert [tuple(r) for r in pixels.flood_areas(img, 0, 0).collect()] == [("i", 0, 0, 2, 3)]
    assert [tuple(r)[1:] for r in pixels.flood_areas(img, 5, 0).collect()] == [(0, 0, 0, 0)]
    big = spark.createDataFrame([([float(i % 7) for i in range(256)],)], "g array<double>")
    bits = ["1" if (i + 1) % 7 > i % 7 else "0" for i in range(256) if i % 16 != 15]
    assert big.select(pixels.frame_hash("g", "gray16")).first()[0] == "".join(f"{int(''.join(bits[k : k + 4]), 2):x}" for k in range(0, 240, 4))
    assert big.select(pixels.frame_hash("g", "whole")).first()[0] == "1"
    f = spark.createDataFrame([("m", 1, [5, 9]), ("m", 2, [7, 3])], "movie_url string, place int, grey array<int>")
    assert [r.difference for r in pixels.frame_difference(f).orderBy("place").collect()] == [None, [0, 6]]


def test_regions_of_odd_rows(spark):
    assert regions.app_gate(spark.createDataFrame([("m", 1, None), ("m", 1, "b"), ("m", 2, "b"), ("m", 3, "a")], "movie_url string, frameset long, app_id string"), "a").select("frameset").distinct().count() == 2
    df = spark.createDataFrame([("x",), (None,)], "a string")
    assert [r[0] for r in df.select(regions.any_of("a", "equals", ["x"])).collect()] == [True, False]
    assert [r[0] for r in df.select(regions.any_of("a", "unknown", ["x"])).collect()] == [False, False]
    with pytest.raises(ValueError):
        regions.manual_areas(spark.createDataFrame([("m", 1)], "movie_url string, frameset long"), spark.range(5), limit=4)
    p = spark.createDataFrame([("0.8",), ("80",), (None,)], "p string")
    assert [r[0] for r in p.select(regions.match_threshold("p", strict=False)).collect()] == [0.8, 0.8, 0.9]


def test_synthetic_values_keep_their_form(spark):
    import re

    rows = plans.PLAIN["t6i_synthetic"](spark, DATA).collect()
    again = {r.app_id: r.synthetic_text for r in plans.PLAIN["t6i_synthetic"](spark, DATA).collect()}
    for r in rows:
        form = re.escape(layout.FORMS.get(r.synthetic_datatype, "*" * 10)).replace(r"\^", "[A-Z]").replace(r"\~", "[a-z]").replace(r"\#", "[0-9]").replace(r"\*", "[A-Z0-9]").replace("~", "[a-z]").replace("#", "[0-9]")
        assert re.fullmatch(form, r.synthetic_text) and again[r.app_id] == r.synthetic_text


def test_results_of_a_job_are_read_alone(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, v int")
    S.write_results(df, str(tmp_path / "r"))
    S.write_results(spark.createDataFrame([("b", 3)], "job_id string, v int"), str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert sorted((r.job_id, r.v) for r in back.collect()) == [("a", 1), ("b", 3)]
    plan = S.result_of(back, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_id" in plan
    archive.write_metadata(df, str(tmp_path / "m"))
    assert sorted(map(tuple, archive.read_metadata(spark, str(tmp_path / "m"), df.schema).collect())) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("name", sorted(plans.PLAIN))
def test_plain_queries_give_rows(spark, name):
    assert plans.PLAIN[name](spark, DATA).count() > 0


def test_texts_of_odd_rows(spark):
    lines = spark.createDataFrame([(" a : b:c ",), ("('x', 'y')",), ("none",), (None,)], "text string")
    assert sorted((r.recording, r.transaction) for r in texts.mappings(lines).collect()) == [("a", "b:c"), ("x", "y")]


def test_seldom_and_areas(spark):
    from veilframe.operators import sifter

    t = [("m", 1, 1, "Inbox", 0, 0, 9, 9), ("m", 1, 2, "Sent", 50, 4, 9, 9), ("m", 1, 3, None, 0, 40, 9, 9), ("m", 2, 4, "Sent", 0, 0, 9, 9), ("m", 2, 5, "Inbox", 50, 0, 9, 9), ("n", 9, 6, "Inbox", 0, 0, 9, 9)]
    df = spark.createDataFrame(t, "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int")
    assert {r.text: r.n_missed for r in sifter.seldom_seen(df).collect()} == {"Inbox": 0, "Sent": 1}
    a = [("m", 1, k, f"t{k}", *n) for k, n in enumerate([(0, 0, 100, 60), (90, 50, 200, 90), (195, 85, 260, 140), (500, 500, 700, 600), (None, 1, 1, 1)])]
    got = sifter.app_areas(spark.createDataFrame(a, "movie_url string, frameset long, uid long, text string, nx1 int, ny1 int, nx2 int, ny2 int")).collect()
    assert [tuple(r)[2:] for r in got] in ([(0, 0, 260, 140, 2, "t1\nt2")], [(0, 0, 260, 140, 3, "t0\nt1\nt2")], [(0, 0, 200, 90, 2, "t0\nt1")])


def test_masked_images_and_meshes(spark):
    import numpy as np

    from veilframe.operators import images

    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (24, 30), dtype=np.uint8)
    i = spark.createDataFrame([("p", a.reshape(-1).tolist(), 30, 24), ("q", None, 3, 3)], "image string, grey array<int>, width int, height int")
    r = spark.createDataFrame([("p", 1, 5, 6, 8, 7), ("p", 2, None, 1, 1, 1)], "image string, ord int, x int, y int, w int, h int")
    for method in images.METHODS:
        got = {x.image: x.grey for x in images.masked(i, r, method).collect()}
        assert got["q"] is None
        out = np.array(got["p"], np.uint8).reshape(24, 30)
        want = a.copy()
        if method.startswith("blur"):
            k = 10 if method == "blur_21x21" else 3
            wide = np.pad(a.astype(int), k, mode="edge" if method == "blur_median" else "reflect")
            for y in range(6, 13):
                for x in range(5, 13):
                    part = wide[y : y + 2 * k + 1, x : x + 2 * k + 1]
                    want[y, x] = np.median(part) if method == "blur_median" else np.rint(part.mean())
        elif method == "black_rectangle":
            want[6:14, 5:14] = 0
        elif method == "background_color":
            want[6:14, 5:14] = np.argmax(np.bincount(a[6:13, 5:13].reshape(-1) // 8, minlength=32))
        else:
            want[5:15, 4:15] = 128
            want[7:13, 6:13] = a[7:13, 6:13]
        assert (out == want).all(), method
    first = np.zeros((20, 20), np.uint8)
    first[3:5, 3] = first[3, 11:13] = first[12, 12] = 255
    first[11:13, 3:5] = 255
    moved = np.roll(first, (2, 3), (0, 1))
    f = spark.createDataFrame([("m", n, x.reshape(-1).tolist(), 20, 20) for n, x in enumerate([first, first, moved, np.zeros((20, 20), np.uint8)])], "movie_url string, place long, grey array<int>, width int, height int")
    m = spark.createDataFrame([("m", 1, 1, 2, 2, 12, 12), ("m", 1, 2, 0, 0, 5, 5)], "movie_url string, place long, uid long, x int, y int, w int, h int")
    assert [tuple(r)[1:] for r in images.mesh_matches(f, m, 4, 0).collect()] == [(2, 5, 4, 12, 12, 4)]
    spots = images.colour_regions(f.selectExpr("concat('i', place) image", "grey", "width", "height").where("image = 'i0'"), spark.createDataFrame([("i0", 0, 0, 10, 20)], "image string, x1 int, y1 int, x2 int, y2 int"), 200, 255)
    assert sorted(tuple(r)[1:] for r in spots.collect()) == [(3, 3, 1, 2), (3, 11, 2, 2)]


def test_missed_items_and_hard_fails(spark):
    from veilframe.operators import scores

    rows = [("a", 1, 100, 0, 0, 0), ("a", 2, 100, 5, 0, 3), ("a", 3, 100, 0, 2, 0), ("b", 1, 100, 0, 0, None), ("b", 2, 0, 0, 0, 5), ("c", 1, 100, 0, 0, 4)]
    df = spark.createDataFrame(rows, "movie_url string, frameset long, total long, f_pos long, f_neg long, missed int")
    got = {(r.movie_url, r.frameset): (r.score, r.failed) for r in scores.frame_scores(df, {"max_num_missed_entities_single_frameset": 2}).collect()}
    assert got == {("a", 1): (100.0, False), ("a", 2): (95.0, True), ("a", 3): (60.0, True), ("b", 1): (100.0, False), ("b", 2): (None, True), ("c", 1): (100.0, True)}
    frames = scores.frame_scores(df, {"max_num_missed_entities_single_frameset": 3})
    soft = {r.movie_url: r.failed for r in scores.movie_scores(frames).collect()}
    hard = {r.movie_url: r.failed for r in scores.movie_scores(frames, {"hard_fail_from_any_frame": True}).collect()}
    assert soft == {"a": False, "b": False, "c": False} and hard == {"a": True, "b": True, "c": True}
    assert {r.failed for r in scores.frame_scores(df.drop("missed")).collect()} == {False, True, None}


def test_start_times_of_both_kinds(spark):
    from veilframe.operators import focus

    screens = spark.createDataFrame([("a", 2, "now 1:02:03 PM"), ("a", 1, "nothing"), ("b", 1, None)], "movie_url string, ord int, text string")
    bars = [("a", k, 1, "10:15 PM") for k in range(3)] + [("b", k, o, t) for k in range(90) for o, t in ((1, "noise"), (2, f"l0.{59 if k < 45 else 0:02} AM"))] + [("c", 0, 1, "10:1x PM"), ("c", 1, 1, None)]
    got = sorted(map(tuple, focus.start_times(screens, spark.createDataFrame(bars, "movie_url string, place int, ord int, text string")).collect()))
    assert got == [("a", 1, 2, 3, "PM", "blue_screen"), ("b", None, 59, 15, None, "taskbar")]
    assert focus.start_times(screens.limit(0), spark.createDataFrame(bars[:0], "movie_url string, place int, ord int, text string")).count() == 0
