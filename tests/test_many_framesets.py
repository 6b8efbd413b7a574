"""Counts of many framesets at once, against cells in plain Python, and groups that come in small batches."""

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import functions as F
from test_masks import by_frame, counts

from veilframe.operators import masks
from veilframe.operators.grouped import many_groups

MARKS = "movie_url string, frameset long, kind string, ord long, polarity string, x int, y int, w int, h int"


def test_rectangles_apart_touching_spanning_and_with_nulls(spark):
    """Before, a null below a given x stopped the job, and each frameset had a grid of its own."""
    rng = np.random.default_rng(7)
    kinds, rows = ["found", "expected", "desired", "unwanted", "pass", "fail"], []
    for n in range(1500):
        for i in range(rng.integers(1, 6)):
            x, y, w, h = (int(v) for v in (rng.integers(-3, 14), rng.integers(-3, 11), rng.integers(-2, 4), rng.integers(-2, 4)))
            w, h = (30 if rng.random() < 0.04 else w), (30 if rng.random() < 0.04 else h)
            kind = kinds[rng.choice(6, p=[0.45, 0.15, 0.15, 0.15, 0.05, 0.05])]
            null = kind in ("pass", "fail") or rng.random() < 0.05
            rows.append((f"m{n % 3}", n, kind, i, "negative" if rng.random() < 0.2 else "positive", x, None if null else y, w, h))
        rows.append((f"m{n % 3}", n, "found", 9, None, None, None, None, None))
    marks = spark.createDataFrame(rows, MARKS)
    placed = marks.withColumn("x", F.when(F.col("y").isNotNull(), F.col("x")))
    got = {(r.movie_url, r.frameset): tuple(r)[2:] for r in masks.score_counts(marks, 12, 9).collect()}
    want = {k: counts(v, 12, 9) for k, v in by_frame(placed).items()}
    assert got == want and len({v[4] for v in want.values()}) > 2


def test_a_crowded_frameset(spark):
    rows = [("m", 1, "found" if i % 2 else "expected", i, "positive", i % 10 * 6, i // 10 * 6, 3, 3) for i in range(masks.MANY + 6)]
    assert [tuple(r)[2:] for r in masks.score_counts(spark.createDataFrame(rows, MARKS), 100, 100).collect()] == [(35 * 16, 10_000 - 35 * 16, 35 * 16, 35 * 16, 35)]


def test_groups_over_several_batches(spark):
    rows = [(k, i) for k, n in (("a", 1), ("b", 25), (None, 12), ("c", 3)) for i in range(n)]
    sums = lambda t, starts: (starts, [np.add.reduceat(t.column("v").to_numpy(), starts), pc.take(t.column("v"), starts)])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = many_groups(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"], sums, "total long, first long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got), key=str) == sorted([("a", 0, 0), ("b", 300, 0), (None, 66, 0), ("c", 3, 0)], key=str)
