"""Recordings written and read back by ranges of seconds."""

from pathlib import Path

from pyspark.sql import functions as F

from veilframe.sources import recordings


def test_ranges_open_their_chunks_alone(spark, tmp_path):
    pixels = lambda k: [(k * 7 + i) % 256 for i in range(12)]
    rows = [(m, s, 4, 3, pixels(s)) for m in ("a/b c", "é", None) for s in range(0, 50) if s != 7]
    odd = [("a/b c", 3, 4, 3, [300] * 12), ("é", -1, 4, 3, pixels(1)), ("é", None, 4, 3, pixels(1)), ("é", 60, 4, 3, None), ("é", 61, 4, 3, [1]), ("é", 70, 2, 2, [9, 8, 7, 6])]
    df = spark.createDataFrame(rows + odd[1:], recordings.SCHEMA).repartition(5)
    path = f"file://{tmp_path}/r"
    recordings.write_recordings(df, path, chunk=10)
    assert not list(Path(tmp_path, "r").rglob(".*"))
    back = recordings.read_recordings(spark, path)
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, back.collect()), key=key) == sorted([*rows, odd[-1]], key=key)
    some = back.where("second >= 12 and second < 25 and movie_url = 'é'")
    assert sorted(r.second for r in some.collect()) == list(range(12, 25))
    assert some.rdd.getNumPartitions() == 2 and back.rdd.getNumPartitions() == 16
    assert [r.second for r in back.where("second = 33 and movie_url is null").collect()] == [33]
    # chunks that nobody asks for may be damaged: they are not opened
    for f in Path(tmp_path, "r").rglob("*.frames"):
        if not f.name.startswith(("10-", "20-")):
            f.write_bytes(b"damaged")
    assert back.where("second between 15 and 22").count() == 8 * 3
    assert back.where("second between 15 and 22 and width > 4").count() == 0
    assert back.where(F.col("movie_url").isin("é", "x") & (F.col("second") > 18) & (F.col("second") <= 21)).count() == 3
    assert recordings.read_recordings(spark, f"file://{tmp_path}/none").count() == 0
    recordings.write_recordings(df.limit(0), f"file://{tmp_path}/empty")
    assert recordings.read_recordings(spark, f"file://{tmp_path}/empty").count() == 0


def test_written_again(spark, tmp_path):
    path = str(tmp_path / "r")
    for grey in (1, 2):
        recordings.write_recordings(spark.createDataFrame([("m", s, 1, 1, [grey]) for s in range(3)], recordings.SCHEMA), path)
    assert [r.grey for r in recordings.read_recordings(spark, path).collect()] == [[2]] * 3
