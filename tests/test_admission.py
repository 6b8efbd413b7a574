"""The admission queue as a running stream, over several batches and a restart."""

import json
import os

from veilframe.streaming import admission

SCHEMA = "queue string, recording string, event string, ts timestamp"


class Run:
    """A stream over a folder of JSON files, one file a batch, run again and again from one checkpoint."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.n = spark, path, 0
        (path / "in").mkdir()
        self.options, self.seen = options, []

    def feed(self, *batches):
        """Write a file for each batch of (queue, recording, event, minutes), run until all are taken, return the new actions."""
        for rows in batches:
            lines = [json.dumps({"queue": q, "recording": r, "event": e, "ts": f"2024-01-0{1 + m // 1440}T{m // 60 % 24:02}:{m % 60:02}:00Z"}) for q, r, e, m in rows]
            file = self.path / "in" / f"{self.n:03}.json"
            file.write_text("\n".join(lines))
            os.utime(file, (1_700_000_000 + self.n,) * 2)  # files are taken in order of their times
            self.n += 1
        raw = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))
        new = []
        out = admission.admissions(raw, lateness="0 minutes", **self.options)
        take = lambda b, k: new.extend((k, r.queue, r.recording, r.action, r.attempt) for r in b.orderBy("queue", "at", "action", "recording").collect())
        q = out.writeStream.foreachBatch(take).option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        self.seen += [x[1:] for x in new]
        return [x[1:] for x in new]


def test_every_item_goes_out_once(spark, tmp_path):
    """Ten items with room for two: nothing is lost, nothing comes twice, over batches, repeated items and restarts."""
    run = Run(spark, tmp_path, throttle=2)
    first = run.feed([("p", f"r{k}", "item", k) for k in (3, 1, 2)], [("p", "r1", "item", 4), ("p", "r4", "item", 5), ("o", "x1", "item", 5)])
    assert first == [("p", "r1", "send", 1), ("p", "r2", "send", 1), ("o", "x1", "send", 1)]
    assert run.feed([("p", "r9", "nonsense", 6), ("p", None, "item", 6), (None, "z", "item", 6)]) == [(None, "z", "send", 1)]
    second = run.feed([("p", "r1", "done", 7)], [("p", "r5", "item", 7), ("p", "r2", "received", 8)], [("p", "r2", "done", 9), ("p", "r3", "done", 9)])
    # the second item of r1 stands behind r3: r1 is done by then, so it is work again
    assert second == [("p", "r3", "send", 1), ("p", "r1", "send", 1), ("p", "r4", "send", 1)]
    third = run.feed([("p", "r1", "done", 10), ("p", "r4", "done", 10)], [("p", "r5", "done", 11)])
    assert third == [("p", "r5", "send", 1)]
    sent = [r for q, r, a, _ in run.seen if q == "p" and a == "send"]
    assert sorted(sent) == ["r1", "r1", "r2", "r3", "r4", "r5"]


def test_in_flight_never_above_the_throttle(spark, tmp_path):
    run = Run(spark, tmp_path, throttle=3)
    items, out, sent, minute = [f"r{k:02}" for k in range(20)], set(), [], 0
    new = run.feed([("p", r, "item", 0) for r in items[:12]], [("p", r, "item", 1) for r in items[12:]])
    while new:
        for _, r, action, _ in new:
            assert action == "send" and r not in sent
            out.add(r)
            sent.append(r)
        assert len(out) <= 3
        minute += 5
        done = sorted(out)[: 1 + minute % 3]
        out -= set(done)
        new = run.feed([("p", r, "done", minute) for r in done]) if done else []
    assert sent == items


def test_stale_items_are_sent_again_once(spark, tmp_path):
    run = Run(spark, tmp_path, throttle=2, retries=1)
    assert run.feed([("p", "a", "item", 0), ("p", "b", "item", 1), ("p", "c", "item", 2)]) == [("p", "a", "send", 1), ("p", "b", "send", 1)]
    assert run.feed([("p", "b", "received", 60)], [("p", "-", "beat", 100)]) == []
    # after more than two hours a is sent again, b was heard of at 60
    assert run.feed([("p", "-", "beat", 123)], [("p", "-", "beat", 124)]) == [("p", "a", "retry", 2)]
    assert run.feed([("p", "a", "received", 130), ("p", "b", "done", 130)], [("p", "c", "received", 140)]) == [("p", "c", "send", 1)]
    # a is stale for the second time: given up, which makes room
    assert run.feed([("p", "d", "item", 200), ("p", "c", "received", 250)], [("p", "-", "beat", 251)], [("p", "-", "beat", 252)]) == [("p", "a", "give_up", 2), ("p", "d", "send", 1)]
    assert run.feed([("p", "-", "beat", 253)]) == []


def test_shards_share_the_throttle(spark, tmp_path):
    run = Run(spark, tmp_path, throttle=4, shards=2)
    new = run.feed([("p", f"r{k}", "item", k) for k in range(30)])
    assert len(new) == 4 and len({r for _, r, *_ in new}) == 4
