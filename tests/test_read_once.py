"""What is used several times is made once, and what is large stays where it is."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veilframe.operators import focus, grouped, layout, regions, sifter


def test_matches_stay_where_they_are_beside_anchors(spark):
    m = spark.createDataFrame([("m", 1, k, f"a{k % 3}-1", 2.0, 10 * k, k) for k in range(6)], "movie_url string, frameset long, uid long, anchor_id string, scale double, x int, y int")
    anchors = spark.createDataFrame([("a0", 1, 1), ("a1", 2, 2)], "anchor string, ax int, ay int")
    zones = spark.createDataFrame([(1, None, 3, 3, 9, 9), (2, "a1-1", 4, 4, 8, 8)], "ord int, zone_anchor string, x1 int, y1 int, x2 int, y2 int")
    got = regions.tier_2(m, anchors, zones)
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(0, 1, 1, 3, 3), (1, 11, 2, 2, 2), (3, 31, 4, 3, 3), (4, 41, 5, 2, 2)]
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (anchor_id" in line]
    assert joins and "broadcast" in joins[0]  # before, all matches of an anchor went to one task


def test_densest_frames_are_found_once(spark):
    t = spark.createDataFrame([("a", 1, 1, "Name", 0, 0, 9, 9), ("a", 1, 2, "Ann", 0, 50, 9, 9), ("b", 2, 3, "Name", 0, 0, 9, 9), ("b", 3, 4, "Ann", 0, 0, 9, 9)], "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int")
    got = sifter.seldom_seen(t)
    assert sorted(map(tuple, got.collect())) == [("Ann", 1), ("Name", 0)]
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()  # before, several times


def test_framesets_are_joined_to_the_next_ones_by_framesets_alone(spark):
    t = [("m", 1, 1, "Name", 0, 0, 9, 9), ("m", 1, 2, "Ann", 0, 50, 9, 9), ("m", 5, 3, "Name", 1, 1, 9, 9), ("m", 9, 4, "Nome", 1, 1, 9, 9), ("m", 9, 5, None, 1, 1, 9, 9), ("n", 5, 6, "x", 1, 1, 9, 9), (None, 5, 7, "x", 1, 1, 9, 9)]
    got = focus.changed_text(spark.createDataFrame(t, "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int"))
    assert sorted(map(tuple, got.collect())) == [("m", 1, 1, "new"), ("m", 1, 2, "new"), ("m", 5, 2, "disappeared"), ("m", 9, 4, "new"), ("m", 9, 5, "altered"), ("n", 5, 6, "new")]
    assert "place" not in got._jdf.queryExecution().optimizedPlan().toString()  # before, the matches were dealt out again by places


def test_only_texts_within_reach_go_to_python(spark):
    w = spark.createDataFrame([("m", 1, 1, "a", 0, 0, "left"), ("m", 1, 2, "b", 1, 0, "left"), ("m", 1, 3, "c", 900, 0, "right"), (None, 2, 1, "d", 0, 0, "left")], "movie_url string, frameset long, ord int, item string, x int, y int, side string")
    t = spark.createDataFrame([("m", 1, 7, 1, 0, 5), ("m", 1, 8, 3, 4, 5), ("m", 1, 9, 895, 0, 5), ("m", 1, 10, 400, 0, 5), (None, 2, 11, 3, 4, None)], "movie_url string, frameset long, uid long, x int, y int, w int")
    got = layout.claimed_neighbours(w, t)
    assert sorted(tuple(r)[2:] for r in got.collect()) == [("a", 7, 1.0), ("b", 8, 20**0.5), ("c", 9, 0.0), ("d", 11, 5.0)]
    assert "<= 200.0" in got._jdf.queryExecution().optimizedPlan().toString()  # before, all texts went


def test_images_are_turned_into_python_a_few_at_a_time():
    """Before, 8192 rows at once, whatever their size."""
    pixels = pa.array(np.zeros(4000 * 1024, np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.ListArray.from_arrays(pa.array(np.arange(4001) * 1024, pa.int32()), pixels)], names=["image", "grey"])
    tracemalloc.start()
    rows = list(r["image"] for r in grouped.rows_of([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == list(range(4000)) and most < 8_000_000
