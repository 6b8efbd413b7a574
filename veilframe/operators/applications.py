"""Applications on a screen, found by the areas of one tone that their texts stand on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.grouped import in_groups
from veilframe.operators.layout import BOX
from veilframe.operators.sets import FRAME
from veilframe.operators.shapes import Tones
from veilframe.operators.sifter import both, grown_together


@dataclass(frozen=True)
class Rules:
    """Sizes in pixels: how far from a text's upper left and lower right corners the tone is taken, and by how much it may change from pixel to pixel; texts that end above
    tabs_end (a browser's tabs and address) have no area but their own; areas of more than most_area are a screen's background; least_overlap of
    areas that belong together; row_gap between rows of text; a header is at most header_height high, header_gap above what it
    belongs to, and header_wider wider or narrower; applications are at least least_width wide and least_height high."""

    aside: int = 5
    tolerance: int = 5
    tabs_end: int = 100
    most_area: int = 1_000_000
    least_overlap: int = 25
    row_gap: int = 10
    header_height: int = 100
    header_gap: int = 10
    header_wider: int = 10
    least_width: int = 100
    least_height: int = 100


@dataclass
class _App:
    box: tuple
    phrases: list
    header: bool = False

    def heads(self, other: _App, rules: Rules) -> bool:
        (x1, y1, x2, y2), (u1, v1, u2, _) = self.box, other.box
        alike = abs((x2 - x1) - (u2 - u1)) <= rules.header_wider
        return self is not other and len(self.phrases) == 1 and 0 <= v1 - y2 <= rules.header_gap and alike and y2 - y1 <= rules.header_height


def _around(text: dict, tones: Tones | None, shape: tuple, rules: Rules) -> tuple:
    """A text's box with the tones' areas left of it and right of it, where these hold its centre."""
    own = x1, y1, x2, y2 = text["x"], text["y"], text["x"] + text["w"], text["y"] + text["h"]
    if tones is None or y2 < rules.tabs_end:
        return own
    out, cx, cy = own, (x1 + x2) // 2, (y1 + y2) // 2
    for x, y in ((max(0, x1 - rules.aside), max(0, y1)), (min(x2 + rules.aside, shape[1] - 1), min(y2, shape[0] - 1))):
        area = tones.box(x, y)
        if area and area[0] <= cx <= area[2] and area[1] <= cy <= area[3]:
            out = both(out, area)
    return own if (out[2] - out[0]) * (out[3] - out[1]) > rules.most_area else out


def _in_rows(texts: list[dict], gap: int) -> Iterator[tuple[int, dict]]:
    """Texts in reading order with their row: a new one begins more than gap below the first text of the last one."""
    row, first, numbered = -1, None, []
    for t in sorted(texts, key=lambda t: (t["y"], t["uid"])):
        if first is None or t["y"] - first > gap:
            row, first = row + 1, t["y"]
        numbered.append((row, t))
    yield from sorted(numbered, key=lambda n: (n[0], n[1]["x"], n[1]["y"], n[1]["uid"]))


def _apps(texts: list[dict], areas: dict, points: list[tuple], rules: Rules) -> list[_App]:
    apps: dict = {}
    for row, own in groupby(_in_rows(texts, rules.row_gap), key=lambda n: n[0]):
        for _, t in own:
            at = apps.setdefault(areas[t["uid"]], {})
            at.setdefault(row, []).append(t["text"])
    out = [_App(box, list(rows.values())) for box, rows in apps.items()]
    for a in out:
        for b in out:
            if a.heads(b, rules):
                b.phrases, b.box, b.header = a.phrases + b.phrases, both(a.box, b.box), True
    free = [a for a in out if not any(a.box[0] <= x <= a.box[2] and a.box[1] <= y <= a.box[3] for x, y in points)]
    some = [a for a in free if len(a.phrases) > 1 or len(a.phrases[0]) > 1]
    return [a for a in some if a.box[2] - a.box[0] >= rules.least_width and a.box[3] - a.box[1] >= rules.least_height]


def movie_apps(texts: DataFrame, images: DataFrame, ignored: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(frame, app, x1, y1, x2, y2, header, phrases): the applications of each frameset, numbered from 0 in reading order of their first texts.

    texts: frame, uid (unique in a frameset), text, x, y, w, h; images: frame, grey (row-major), width, height; ignored: frame, x, y.

    1. A text's area is its box with the area of like tones left of its upper left corner and the one right of its lower right
       corner, each only if it holds the text's centre (Rules says what is too high up and too large).
    2. In order of uid, areas that overlap grow together (sifter.grown_together); texts of one area are one application.
    3. phrases: its texts by rows, from above, each from the left.
    4. A single row directly above an application of the same width is put before it as its header; it stays an application of
       its own, too. This goes through all pairs in order, so that headers can be stacked.
    5. Applications that hold an ignored point (templates that were found there), single texts, and narrow and low ones are left out.

    A frameset is one screen: its image and texts come to one task, first the image, then the texts. Framesets without an image
    have the texts' own boxes; of several images the first by their pixels counts. Texts without a place are left out, null
    texts stay as null phrases. Empty tables give no rows.
    """
    parts = [
        images.where("grey is not null and width > 0 and height > 0 and size(grey) = width * height").select(*FRAME, F.lit(0).alias("part"), "grey", F.col("width").alias("w"), F.col("height").alias("h")),
        texts.where(BOX).select(*FRAME, F.lit(1).alias("part"), "uid", "text", "x", "y", "w", "h"),
    ]
    if ignored is not None:
        parts.append(ignored.where("x is not null and y is not null").select(*FRAME, F.lit(2).alias("part"), "x", "y"))
    rows = parts[1]
    for p in (parts[0], *parts[2:]):
        rows = rows.unionByName(p, allowMissingColumns=True)

    def find(rows):
        grey, shape, own, points = None, (0, 0), [], []
        for r in rows:
            if r["part"] == 0 and grey is None:
                shape = r["h"], r["w"]
                grey = r["grey"]
            elif r["part"] == 1:
                own.append(r)
            elif r["part"] == 2:
                points.append((r["x"], r["y"]))
        if not own:
            return []
        tones = None if grey is None else Tones(np.array(grey, np.int64).reshape(shape), rules.tolerance)
        areas = grown_together([_around(t, tones, shape, rules) for t in own], rules.least_overlap)
        found = _apps(own, {t["uid"]: a for t, a in zip(own, areas, strict=True)}, points, rules)
        return [(i, *a.box, a.header, a.phrases) for i, a in enumerate(found)]

    return in_groups(rows, list(FRAME), ["part", "uid", "grey"], find, "app int, x1 int, y1 int, x2 int, y2 int, header boolean, phrases array<array<string>>", arrays=True)
