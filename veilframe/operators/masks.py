"""Masks of rectangles (both edges inside) as grids of the strips between their edges: exact, without pixels.

Each function works on one frameset at a time. Rectangles are cut to the frame; null ones and those outside are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.boxes import union_area
from veilframe.operators.grouped import in_groups, many_groups
from veilframe.operators.sets import FRAME
from veilframe.operators.shapes import outer_components

WIDTH, HEIGHT = 1920, 1080
#: What a rectangle or a verdict is to score_counts().
KINDS = {"found": 0, "expected": 1, "desired": 2, "unwanted": 3, "pass": 4, "fail": 5}
#: Framesets of more rectangles are not compared pair by pair.
MANY = 64


class Canvas:
    """The strips between the edges of a frameset's rectangles and of the frame."""

    def __init__(self, rects: list[tuple], width: int, height: int):
        inside = [r for r in rects if r[0] is not None]
        edges = lambda values, most: sorted({0, most, *(min(max(int(v), 0), most) for v in values)})
        self.xs = edges((v for x, _, w, _ in inside for v in (x, x + w + 1)), width)
        self.ys = edges((v for _, y, _, h in inside for v in (y, y + h + 1)), height)
        self.size = np.multiply.outer(*(np.array([b - a for a, b in pairwise(at)], np.int64) for at in (self.ys, self.xs)))

    def blank(self) -> np.ndarray:
        return np.zeros(self.size.shape, bool)

    def paint(self, grid: np.ndarray, rect: tuple, value: bool = True) -> None:
        x, y, w, h = rect
        if x is None:
            return
        a, b, c, d = bisect_left(self.xs, x), bisect_left(self.xs, x + w + 1), bisect_left(self.ys, y), bisect_left(self.ys, y + h + 1)
        grid[c:d, a:b] = value

    def area(self, grid: np.ndarray) -> int:
        return int(self.size[grid].sum())

    def box(self, c: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        x, y = self.xs[c[0]], self.ys[c[1]]
        return x, y, self.xs[c[2] + 1] - x, self.ys[c[3] + 1] - y


def _rect(r: dict) -> tuple:
    return r["x"], r["y"], r["w"], r["h"]


def intersected(matches: DataFrame, jobs: list[str], width: int = 2000, height: int = 4000) -> DataFrame:
    """Boxes (x, y, w, h: whole pixels) around what is covered by every job (job_id): per frameset the rectangles of each job
    are added up, the jobs' masks cut with each other, and the components of what is left boxed. Framesets that one of
    the jobs doesn't have are left out."""
    wanted = sorted(set(jobs))

    def boxes(rows):
        by: dict = {}
        for r in rows:
            by.setdefault(r["job_id"], []).append(_rect(r))
        if len(by) < len(wanted):
            return []
        canvas = Canvas([x for v in by.values() for x in v], width, height)
        both = ~canvas.blank()
        for rects in by.values():
            own = canvas.blank()
            for x in rects:
                canvas.paint(own, x)
            both &= own
        return sorted(canvas.box(c) for c in outer_components(both))

    rows = matches.where(F.col("job_id").isin(wanted)).select(*FRAME, "job_id", "x", "y", "w", "h")
    return in_groups(rows, list(FRAME), ["job_id"], boxes, "x int, y int, w int, h int")


def painted_area(matches: DataFrame, order: list[str], width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Pixels that are covered after all rectangles have been painted in order, those of polarity 'negative' blank."""

    def area(rows):
        rows = [(_rect(r), r["polarity"] != "negative") for r in rows]
        canvas = Canvas([r for r, _ in rows], width, height)
        grid = canvas.blank()
        for r, on in rows:
            canvas.paint(grid, r, on)
        return [(canvas.area(grid),)]

    return in_groups(matches.select(*FRAME, "x", "y", "w", "h", "polarity", *order), list(FRAME), order, area, "area long")


def frame_counts(found: DataFrame, standard: DataFrame, total: int = WIDTH * HEIGHT) -> DataFrame:
    """Pixels of each frameset that either side has: t_pos (standard), t_neg (the rest), f_pos (found alone), f_neg (standard alone).

    From areas of unions: what is found alone is what both cover together less what the standard covers. For
    positive rectangles inside the frame; score_counts() takes all kinds.
    """
    sides = found.select(*FRAME, "x", "y", "w", "h", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("side"))
    sides = sides.unionByName(standard.select(*FRAME, "x", "y", "w", "h", F.explode(F.array(F.lit("s"), F.lit("b"))).alias("side")))
    area = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("area"))), F.lit(0))
    by = union_area(sides, (*FRAME, "side")).groupBy(*FRAME).agg(area("f").alias("f"), area("s").alias("s"), area("b").alias("b"))
    return by.select(*FRAME, F.col("s").alias("t_pos"), (F.lit(total) - F.col("s")).alias("t_neg"), (F.col("b") - F.col("s")).alias("f_pos"), (F.col("b") - F.col("f")).alias("f_neg"))


def score_counts(marks: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """t_pos, t_neg, f_pos, f_neg (pixels) and missed (items) of each frameset, from found rectangles and people's marks.

    marks: frameset, kind, ord, polarity, x, y, w, h. kind found: painted in order, polarity 'negative' blank. desired and
    unwanted: what should have been found is the found mask with the desired painted and then the unwanted blanked.
    expected: a standard that is right by itself, whatever was found. pass: all that was found is right; fail: just
    everything else would have been. Framesets with none of these marks pass (f_pos and f_neg are 0). An expected component counts
    as missed if the first and the last corner of its box are missing.

    Framesets whose rectangles all lie apart are told by their areas alone, many at once; the others on grids, one by one.
    """
    codes = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])

    def counts(t, starts):
        col = lambda name, none=0: t.column(name).fill_null(none).combine_chunks().to_numpy(zero_copy_only=False)
        kind, blank, (x, y, w, h) = col("kind"), col("blank", False), (col(c).astype(np.int64) for c in "xywh")
        there = np.logical_and.reduce([t.column(c).combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in "xywh"])
        n = len(starts)
        group = np.repeat(np.arange(n), np.diff(np.append(starts, len(kind))))
        x1, y1, x2, y2 = np.maximum(x, 0), np.maximum(y, 0), np.minimum(x + w + 1, width), np.minimum(y + h + 1, height)
        size = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
        drawn = there & (size > 0) & (kind <= KINDS["unwanted"])
        total = lambda of, what: np.bincount(group[of], what[of], n).astype(np.int64)
        has = lambda k: np.bincount(group[kind == KINDS[k]], minlength=n) > 0
        on = drawn & (kind == KINDS["found"]) & ~blank
        asked = drawn & ((kind == KINDS["expected"]) | (kind == KINDS["desired"]))
        found, more, items = total(on, size), total(asked, size), np.bincount(group[asked], minlength=n)
        corner = on & (((x1 == 0) & (y1 == 0)) | ((x2 == width) & (y2 == height)))
        right, wrong, standard, every = has("pass"), has("fail"), has("expected"), width * height
        pick = lambda passed, failed, expected, else_: np.where(right, passed, np.where(wrong, failed, np.where(standard, expected, else_)))
        out = np.stack([
            pick(found, every - found, more, found + more),
            pick(every - found, found, every - more, every - found - more),
            pick(0, found, found, 0),
            pick(0, every - found, more, more),
            pick(0, np.bincount(group[corner], minlength=n) == 0, items, items),
        ])
        # what spans the frame may part what is not found
        hard = np.bincount(group[on & (((x1 == 0) & (x2 == width)) | ((y1 == 0) & (y2 == height)))], minlength=n) > 0
        hard |= _touching(group, n, drawn, x1, y1, x2, y2)
        ends = np.append(starts, len(kind))
        for g in np.flatnonzero(hard):
            own = slice(ends[g], ends[g + 1])
            rects = [v if ok else (None,) * 4 for ok, *v in zip(there[own].tolist(), *(c[own].tolist() for c in (x, y, w, h)), strict=True)]
            out[:, g] = _counted(rects, kind[own].tolist(), blank[own].tolist(), width, height)
        return starts, list(out)

    rows = marks.select(*FRAME, F.coalesce(F.try_element_at(codes, "kind"), F.lit(len(KINDS))).alias("kind"), "ord", (F.col("polarity") == "negative").alias("blank"), "x", "y", "w", "h")
    return many_groups(rows, list(FRAME), ["ord"], counts, "t_pos long, t_neg long, f_pos long, f_neg long, missed int")


def _touching(group: np.ndarray, n: int, drawn: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """For each of n groups whether any of its drawn rectangles (far edges outside) overlap or touch, corners included. Groups of more than
    MANY count as if they did."""
    many = np.bincount(group[drawn], minlength=n) > MANY
    at = np.flatnonzero(drawn & ~many[group])
    g, a, b, c, d = (v[at] for v in (group, x1, y1, x2, y2))
    for k in range(1, MANY):
        same = np.flatnonzero(g[k:] == g[:-k])
        if not len(same):
            break
        p, q = same, same + k
        many[g[p[(a[p] <= c[q]) & (a[q] <= c[p]) & (b[p] <= d[q]) & (b[q] <= d[p])]]] = True
    return many


def _counted(rects: list[tuple], kinds: list[int], blank: list[bool], width: int, height: int) -> tuple[int, int, int, int, int]:
    """What score_counts() tells of one frameset, on the grid of its rectangles' strips."""
    canvas = Canvas(rects, width, height)
    found = canvas.blank()
    for r, k, off in zip(rects, kinds, blank, strict=True):
        if k == KINDS["found"]:
            canvas.paint(found, r, not off)
    want = canvas.blank() if KINDS["expected"] in kinds else found.copy()
    for value, marked in ((True, (KINDS["expected"], KINDS["desired"])), (False, (KINDS["unwanted"],))):
        for r, k in zip(rects, kinds, strict=True):
            if k in marked:
                canvas.paint(want, r, value)
    if KINDS["pass"] in kinds:
        want = found
    elif KINDS["fail"] in kinds:
        want = ~found
    extra, lost = found & ~want, want & ~found
    missed = sum(1 for a, b, c, d in outer_components(want) if lost[b, a] and lost[d, c]) if lost.any() else 0
    return canvas.area(want), width * height - canvas.area(want), canvas.area(extra), canvas.area(lost), missed


def share_of_frame(matches: DataFrame, total: int = WIDTH * HEIGHT) -> DataFrame:
    """Share of the frame that a frameset's rectangles cover together, in percent with 4 digits."""
    return union_area(matches).select(*FRAME, F.bround(100.0 * F.col("area") / total, 4).alias("percent"))
