"""The queue of recordings: parsing, admission and the stale retry."""

from veilframe.streaming import queue


def test_parse_admit_and_retry(spark):
    good = '{"accountId": "%d", "timestamp": "2024-01-02T03:04:0%d.000000Z", "value": "r%d", "agentId": "a"}'
    rows = [(good % (k, k, k), "p") for k in (3, 1, 2)] + [("no json", "p"), (good % (4, 4, 4), "other"), (None, "p"), ('{"accountId": "x", "timestamp": "2024-01-02T03:04:05.000000Z", "value": "r"}', "p")]
    items = queue.parse_items(spark.createDataFrame(rows, "Annotation string, Pipeline string"), ["p"])
    assert sorted((r.account, r.recording) for r in items.collect()) == [(1, "r1"), (2, "r2"), (3, "r3")]
    assert [r.recording for r in queue.admitted(items, running=23).collect()] == ["r1", "r2"]
    assert queue.admitted(items, running=30).count() == 0


def test_stale_retry(spark):
    rows = [("a", "2024-01-01 00:00:00", "running", 1), ("b", "2024-01-01 01:00:00", "running", None), ("c", "2024-01-01 00:30:00", "success", 0), ("d", "2024-01-01 04:00:00", "running", 0), ("e", None, "running", 0), ("f", "2024-01-01 01:00:00", None, 0)]
    df = spark.createDataFrame(rows, "recording string, ts string, status string, retries int").selectExpr("recording", "cast(ts as timestamp) ts", "status", "retries")
    assert [r.recording for r in queue.to_retry(df, "2024-01-01 05:00:00").collect()] == ["b"]
    assert queue.to_retry(df.limit(0), "2024-01-01 05:00:00").count() == 0


def test_running_stream(spark, tmp_path):
    """Files that arrive one after the other: bad items go, each recording comes out once, and the rest waits its turn."""
    from pyspark.sql import functions as F

    from veilframe.streaming import admission

    item = lambda k, s: {"Annotation": '{"accountId": "1", "timestamp": "2024-01-02T03:04:%02d.000000Z", "value": "r%d", "agentId": "a"}' % (s, k), "Pipeline": "p"}
    seen: list = []

    def run(rows):
        spark.createDataFrame(rows, "Annotation string, Pipeline string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        raw = spark.readStream.schema("Annotation string, Pipeline string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        items = queue.parse_items(raw, ["p", "ended"])
        events = items.select(F.lit("p").alias("queue"), "recording", F.when(F.col("pipeline") == "ended", "done").otherwise("item").alias("event"), "ts")
        q = admission.admissions(events, throttle=1).writeStream.foreachBatch(lambda b, n: seen.append([r.recording for r in b.collect()]))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    ended = lambda k, s: item(k, s) | {"Pipeline": "ended"}
    run([item(1, 1), {"Annotation": "bad", "Pipeline": "p"}])
    run([item(2, 3), item(3, 5)])
    run([ended(1, 6)])
    run([ended(2, 7)])
    assert [r for b in seen for r in b] == ["r1", "r2", "r3"] and all(len(b) <= 1 for b in seen)
    raw = spark.readStream.schema("Annotation string, Pipeline string").json(str(tmp_path / "in"))
    assert queue.first_arrivals(queue.parse_items(raw, ["p"])).isStreaming
    dispatched = spark.createDataFrame([("r1", 1), ("r2", 2)], "recording string, n int")
    received = spark.createDataFrame([("r2",), (None,)], "recording string")
    assert [r.recording for r in queue.unreceived(dispatched, received).collect()] == ["r1"]
    assert queue.has_room(spark.createDataFrame([("running",), ("success",), (None,)], "status string"), unreceived=2, throttle=4)
    assert not queue.has_room(spark.createDataFrame([("running",)], "status string"), unreceived=3, throttle=4)


def test_equal_texts_are_alike(spark):
    from veilframe.functions import text as T

    rng = __import__("random").Random(1)
    words = ["", "a", "ab\U0001f600c", "x" * 62, "y" * 70] + ["".join(rng.choices("abcde", k=rng.randrange(1, 90))) for _ in range(40)]

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        return 100 if a == b else round(200.0 * row[-1] / (len(a) + len(b)))

    pairs = spark.createDataFrame([(a, b) for a in words for b in words[::3]], "a string, b string")
    assert all(r.r == ratio(r.a, r.b) for r in pairs.withColumn("r", T.indel_ratio("a", "b")).collect())
