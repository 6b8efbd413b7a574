"""Groups of repeats have every occurrence, exact copies too."""

import random
from collections import defaultdict

import pytest

from veilframe.llm import substrings


@pytest.mark.parametrize("parts", [1, 3])
def test_every_occurrence_has_its_group(spark, parts, monkeypatch):
    monkeypatch.setattr(substrings, "PART_ANCHORS", 20)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    copy, passage, other = text(400), text(180), text(130)
    rows = [(i, copy) for i in range(5)] + [(10 + i, text(50 + i) + "#" + passage + "#" + text(40)) for i in range(4)]
    rows += [(20 + i, text(30 + i) + "xyz"[i % 3] + passage + "$" + text(20)) for i in range(4)] + [(30, other), (31, other), (31, other), (40, text(300)), (41, None), (42, "z" * 99)]
    whole = {i: t.encode() for i, t in rows if t}
    got = substrings.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert all(r.group is not None for r in got) and len({(r.group, r.id, r.start) for r in got}) == len(got)
    groups = defaultdict(list)
    for r in got:
        groups[r.group].append(r)
    covered = defaultdict(set)
    for rows_of in groups.values():
        (string,) = {whole[r.id][r.start : r.end] for r in rows_of}
        want = {(i, p) for i, t in whole.items() for p in range(len(t) - len(string) + 1) if t[p : p + len(string)] == string}
        assert len(string) >= 100 and len(want) > 1 and {(r.id, r.start) for r in rows_of} == want
        assert {(r.id, r.start) for r in rows_of if not r.later} == {min(want)}
        for i, p in want:
            covered[i] |= set(range(p, p + len(string)))
    counts = defaultdict(int)
    for t in whole.values():
        for p in range(len(t) - 99):
            counts[t[p : p + 100]] += 1
    for i, t in whole.items():
        assert covered[i] == {q for p in range(len(t) - 99) if counts[t[p : p + 100]] > 1 for q in range(p, p + 100)}
