"""Images are looked at where they are, as numpy arrays; rows of Arrow batches keep their values and nulls."""

import re

import numpy as np
import pyarrow as pa

from veilframe.operators import features, grouped, screens


def test_screens_and_features_shuffle_no_image(spark):
    i = spark.createDataFrame([("m", 1, [7] * 64, 8, 8), ("m", 1, [7] * 64, 8, 8), ("m", 2, None, 8, 8), ("m", 3, [1], 8, 8), ("m", 4, [], 0, 0)], "movie_url string, frameset long, grey array<int>, width int, height int")
    for out in (screens.screens(i), features.features(i, ["movie_url", "frameset"])):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.frameset, r.screen) for r in screens.screens(i).collect()] == [(1, 0), (1, 0)]


def test_rows_of_batches():
    cols = {"i": pa.array([1, None, 3]), "f": pa.array([0.5, None, 2.0]), "b": pa.array([True, None, False]), "s": pa.array(["a", None, ""]), "l": pa.array([[1, 2], None, []], pa.list_(pa.int32())), "n": pa.array([[1, None], [2], None], pa.list_(pa.int32())), "t": pa.array([{"x": 1}, None, {"x": None}])}
    batch = pa.RecordBatch.from_pydict(cols)
    assert list(grouped.rows_of([batch])) == batch.to_pylist() and list(grouped.rows_of([batch.slice(1, 2)], most=1)) == batch.to_pylist()[1:]
    assert all(type(r["i"]) in (int, type(None)) for r in grouped.rows_of([batch]))
    lists = [r["l"] for r in grouped.rows_of([batch.slice(0, 2)], arrays=True)]
    assert isinstance(lists[0], np.ndarray) and lists[0].tolist() == [1, 2] and lists[1] is None


def test_hotspots_are_counted_by_frameset(spark):
    """A movie's framesets go to several tasks, and a frameset counts once for each pixel."""
    from veilframe.operators import focus

    rows = [("m", f, f * 10 + k, 2, 2, 3, 3) for f in range(40) for k in range(2)] + [("m", f, f * 10 + 5, 30, 30, 0, 0) for f in range(30)]
    rows += [("m", 99, 990, 20, 20, 3, 3), ("n", 1, 1, 2, 2, 3, 3), ("n", 2, 2, None, 2, 3, 3)]
    df = spark.createDataFrame(rows, "movie_url string, frameset long, uid long, x int, y int, w int, h int")
    out = focus.without_hotspots(df, 60, 40, least_pixels=4, bins=4)
    assert re.search(r"hashpartitioning\(movie_url#\d+, frameset#\d+L", out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.uid for r in out.collect()) == [1, *range(5, 300, 10), 990]


def test_grey_values_are_doubles_on_both_sides(spark, tmp_path):
    """A float just below a step: added in single precision it would be taken for the step itself."""
    import duckdb
    import pyarrow.parquet as pq

    from veilframe.plans import layouts
    from veilframe.plans.registry import ORACLES

    v = np.zeros(64, np.float32)
    v[18] = np.nextafter(np.float32(-0.15625), np.float32(-1))
    pq.write_table(pa.table({"vec_id": pa.array([1], pa.int64()), "embedding": pa.array([v.tolist()], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    sql = ORACLES["t3b_arrow"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet'")
    got = [tuple(r) for r in layouts.t3b_arrow(spark, str(tmp_path)).collect()]
    assert got == duckdb.sql(sql).fetchall() and got[0][1] == 2
