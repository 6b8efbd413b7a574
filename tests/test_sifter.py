"""The sifter on known screens, and each step of the confirming pass beside a plain version of its rule."""

import random

from veilframe.operators import sifter

LAYOUT = "app_id string, type string, text string, x int, y int, row_no int, row_pos int, left_no int, left_pos int, right_no int, right_pos int"
TEXTS = "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int"


def test_known_screen(spark):
    """A label whose row is not matched is known from its column; the field beside it is then found by its place."""
    items = [
        ("a", "label", "Name", 10, 10, 1, 1, 1, 1, None, None), ("b", "user_data", None, 100, 10, 1, 2, 2, 1, None, None),
        ("c", "label", "Street", 10, 50, 2, 1, 1, 2, None, None), ("d", "user_data", None, 100, 50, 2, 2, 2, 2, None, None),
        ("e", "label", "City", 10, 90, 3, 1, 1, 3, None, None), ("f", "user_data", None, 100, 90, 3, 2, 2, 3, None, None),
        ("g", "label", "Nowhere", 400, 400, None, None, None, None, 1, 1),
    ]
    texts = [
        ("m", 1, 1, "Name", 20, 20, 40, 12), ("m", 1, 2, "Ann Onym", 110, 21, 60, 12), ("m", 1, 3, "Streel", 20, 60, 40, 12), ("m", 1, 4, "Lane 1", 112, 75, 60, 12),
        ("m", 1, 5, "City", 21, 100, 40, 12), ("m", 1, 6, "Town", 111, 101, 30, 12), ("m", 2, 7, "Nothing", 1, 1, 5, 5), ("m", 2, 8, None, 1, 30, 5, 5), ("m", 1, 9, "far", 900, 900, 5, 5),
    ]
    lay, df = spark.createDataFrame(items, LAYOUT), spark.createDataFrame(texts, TEXTS).withColumn("kind", __import__("pyspark").sql.functions.lit("x"))
    got = {r.app_id: (r.uid, r.text, r.how, r.carried) for r in sifter.sift(df, lay, least_total=400).collect()}
    assert got["a"][:3] == (1, "Name", "left_col") and got["c"][:2] == (3, "Streel") and got["e"][:2] == (5, "City") and "g" not in got
    assert got["b"] == (2, "Ann Onym", "row", 1) and got["f"] == (6, "Town", "row", 1)
    assert got["d"] == (4, "Lane 1", "near", 1)
    assert sifter.sift(df, lay, least_total=4000).count() == 0 and sifter.sift(df.limit(0), lay).count() == 0 and sifter.sift(df, lay.limit(0)).count() == 0


def screen(seed):
    """A made-up layout, texts and matched rows and columns; some items stand in several."""
    rng = random.Random(seed)
    items = [{"app_id": f"i{k}", "type": rng.choice(("label", "user_data")), "text": f"t{rng.randrange(4)}", "x": rng.randrange(300), "y": rng.choice((0, 40, 80, 120)), "min_width": rng.choice((None, None, 30))} for k in range(12)]
    for r in items:
        for no, pos in sifter.KINDS.values():
            r[no] = rng.choice((None, 1, 2, 3))
            r[pos] = rng.randrange(1, 9)
    texts = [{"uid": u, "text": "x", "x": rng.randrange(0, 300), "y": rng.randrange(0, 200), "w": rng.randrange(10, 60), "h": 9, "labels": [f"t{j}" for j in range(4) if rng.random() < 0.4] or None, "cells": None} for u in range(10)]
    for kind in sifter.KINDS:
        for no in (1, 2, 3):
            if rng.random() < 0.6:
                for pos, u in enumerate(rng.sample(range(10), rng.randrange(0, 6))):
                    texts[u]["cells"] = [*(texts[u]["cells"] or []), {"kind": kind, "app_row": no, "ocr_pos": pos}]
    return items, texts


def plain(items, texts, reach):
    spec = {r["app_id"]: r for r in items}
    groups = []
    for kind, (no, pos) in sifter.KINDS.items():
        for n in sorted({r[no] for r in items if r[no]}):
            groups.append((kind, n, [{"id": r["app_id"]} for r in sorted((r for r in items if r[no] == n), key=lambda r: (r[pos], r["app_id"]))]))
    by = {t["uid"]: t for t in texts}
    for kind, n, cells in groups:
        line = [u for _, u in sorted((c["ocr_pos"], t["uid"]) for t in texts for c in t["cells"] or [] if (c["kind"], c["app_row"]) == (kind, n))]
        skip = 0
        for cell in cells:
            for i, u in list(enumerate(line[skip:])):
                if spec[cell["id"]]["type"] == "label":
                    if spec[cell["id"]]["text"] in (by[u]["labels"] or []):
                        skip, cell["uid"] = skip + i + 1, u
                elif by[u]["w"] >= (spec[cell["id"]]["min_width"] or 0):
                    skip, cell["uid"] = skip + i + 1, u
                    break

    def spread():
        known = {}
        for _, _, cells in groups:
            known |= {c["id"]: c["uid"] for c in cells if "uid" in c}
        for _, _, cells in groups:
            for c in cells:
                if c["id"] in known:
                    c.setdefault("uid", known[c["id"]])
        return known

    spread()
    tops = [(spec[c[0]["id"]]["y"], by[c[0]["uid"]]["y"]) for c in ([c for c in cells if "uid" in c] for kind, _, cells in groups if kind == "row") if c]
    ratios = [(o - tops[0][1]) / (a - tops[0][0]) for a, o in tops[1:] if a != tops[0][0]]
    scale = sum(ratios) / len(ratios) if ratios else 1.0
    first = next((spec[cells[0]["id"]]["y"] for kind, _, cells in groups if kind == "row"), 0)
    origin = tops[0][1] - (tops[0][0] - first) * scale if ratios else 0.0
    busy = {c["uid"] for _, _, cells in groups for c in cells if "uid" in c}
    for kind, _, cells in groups:
        for c in cells if kind == "row" else ():
            if "uid" in c:
                continue
            column = next(((k, cs) for k, _, cs in groups if k == "left_col" and any(x["id"] == c["id"] for x in cs)), None) or next(((k, cs) for k, _, cs in groups if k == "right_col" and any(x["id"] == c["id"] for x in cs)), None)
            seen = next((x["uid"] for x in column[1] if "uid" in x), None) if column else None
            edge = lambda t, k: t["x"] + t["w"] * (k == "right_col")
            if seen is None or not edge(by[seen], column[0]):
                continue
            y = int((spec[c["id"]]["y"] - first) * scale) + origin
            near = min((((edge(t, column[0]) - edge(by[seen], column[0])) ** 2 + (t["y"] - y) ** 2) ** 0.5, u) for u, t in by.items() if u not in busy) if len(busy) < len(by) else (reach + 1, None)
            if near[0] <= reach:
                c["uid"] = near[1]
                busy.add(near[1])
    return spread()


def test_confirmed_like_a_plain_version():
    near = carried = 0
    for seed in range(300):
        items, texts = screen(seed)
        got = sifter._Screen(sifter._Layout(items), texts, 60.0).confirm()
        assert {item: uid for item, uid, *_ in got} == plain(items, texts, 60.0), seed
        near += sum(how == "near" for *_, how, _ in got)
        carried += sum(n for *_, n in got)
    assert near > 50 and carried > 100


def test_ids_that_only_carrying_finds():
    """Without the second step the field has no column to be found by."""
    items = [dict(app_id=i, type=t, text=x, x=0, y=y, min_width=None, row_no=r, row_pos=p, left_no=c, left_pos=q, right_no=None, right_pos=None) for i, t, x, y, r, p, c, q in [("a", "label", "A", 0, 1, 1, 1, 1), ("b", "label", "B", 40, 2, 1, 1, 2), ("c", "user_data", None, 40, 2, 2, 2, 1), ("d", "user_data", None, 0, 1, 2, 2, 2)]]
    texts = [dict(uid=u, text="", x=x, y=y, w=9, h=9, labels=lab, cells=c) for u, x, y, lab, c in [(1, 5, 10, ["A"], [dict(kind="row", app_row=1, ocr_pos=0)]), (2, 50, 10, None, [dict(kind="row", app_row=1, ocr_pos=1)]), (3, 5, 50, ["B"], [dict(kind="left_col", app_row=1, ocr_pos=1)]), (4, 52, 51, None, None)]]
    s = sifter._Screen(sifter._Layout(items), texts, 20.0)
    assert {i: (u, how) for i, u, _, how, _ in s.confirm()} == {"a": (1, "row"), "b": (3, "left_col"), "c": (4, "near"), "d": (2, "row")}
    alone = sifter._Screen(sifter._Layout(items), texts, 20.0)
    alone.carry = lambda: None
    assert "c" not in {i for i, *_ in alone.confirm()}


def test_rows_are_matched_as_the_single_steps_match_them(spark):
    """One pass over a screen finds the rows that grouping, scoring and assigning find as steps of their own."""
    from veilframe.operators import layout as L

    rng = random.Random(5)
    items, texts = [], []
    for k in range(9):
        items.append({"app_id": f"i{k}", "type": "label", "text": f"label{k % 7}", "x": 0, "y": 0, "min_width": None} | {c: v for no, pos in sifter.KINDS.values() for c, v in ((no, k // 3 + 1), (pos, k % 3 + 1))})
    for f in range(12):
        for u in range(9):
            texts.append({"movie_url": "m", "frameset": f, "uid": u, "text": f"label{rng.randrange(9)}", "x": rng.randrange(0, 200, 20), "y": rng.randrange(0, 100, 10), "w": 40, "h": 12})
    groups = {}
    df = spark.createDataFrame([tuple(t.values()) for t in texts], TEXTS)
    for r in sifter.grouped_texts(df).collect():
        groups.setdefault((r.frameset, r.kind), []).append(r)
    for f in range(12):
        own = [t | {"labels": [t["text"]] if t["text"] < "label7" else None, "ratios": [100] if t["text"] < "label7" else None} for t in texts if t["frameset"] == f]
        screen, want, totals = sifter._Screen(sifter._Layout(items), own, 10.0), {}, 0
        for kind, (no, pos) in sifter.KINDS.items():
            cells = [(r.ocr_row, i[no], i[pos], r.ocr_pos, 100) for r in groups[f, kind] for i in items if i["text"] == r.text]
            best = L.best_rows(L.quick_rows(cells, 70)) if cells else []
            totals += best[0][3] if best else 0
            for app, ocr, _, _ in best:
                want[kind, app] = [r.uid for r in sorted(groups[f, kind], key=lambda r: r.ocr_pos) if r.ocr_row == ocr]
        assert screen.match_groups(70, 1) == bool(want) and screen.members == want
        assert not sifter._Screen(sifter._Layout(items), own, 10.0).match_groups(70, int(totals) + 1)


def test_sift_shuffles_its_texts_once(spark):
    """No joins and windows over all texts: they go by frameset once (before: three joins, two windows and five groupings)."""
    lay = spark.createDataFrame([("a", "label", "Name", 10, 10, 1, 1, 1, 1, None, None)], LAYOUT)
    df = spark.createDataFrame([("m", 1, 1, "Name", 20, 20, 40, 12)], TEXTS)
    plan = sifter.sift(df, lay)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1
