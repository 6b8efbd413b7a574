"""Screens of a desktop in a frame: rows between long lines, without the taskbar and the dead space at the sides, cut at vertical lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from veilframe.operators import shapes
from veilframe.operators.grouped import each_image

#: Fixed values of the rules, in pixels and shares.
STRENGTH, MARGIN, FROM_EDGE, TOP_BAND, DEAD_WIDTH, BAR_AREA, BAR_WIDTH, BAR_FROM = 100, 10, 100, (5, 100), 100, 50, 0.25, 0.9


def calm(a: np.ndarray, upright: bool, reach: int) -> np.ndarray:
    """What is no line: gradients, widened across the line by `reach`, that don't stay strong over `reach` pixels along it."""
    s = shapes.strength(a)
    s = shapes.eroded(shapes.dilated(s, reach, 0), 0, reach) if upright else shapes.eroded(shapes.dilated(s, 0, reach), reach, 0)
    return s <= STRENGTH


def rows_of(a: np.ndarray, reach: int) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of the calm areas across the whole width, but for those that begin within 100 pixels of the bottom or 6 to
    99 pixels from the top; the whole image if there is none."""
    out = []
    for x, y, w, h, _ in shapes.Runs(calm(a, False, reach)).boxes().tolist():
        if a.shape[1] - w < MARGIN and a.shape[0] - y >= FROM_EDGE and not TOP_BAND[0] < y < TOP_BAND[1]:
            out.append((x, y, x + w, y + h))
    return out or [(0, 0, a.shape[1], a.shape[0])]


def without_taskbar(a: np.ndarray, reach: int) -> np.ndarray:
    """The image above the lowest of the wide areas that begin in its last tenth."""
    white = a.copy()
    white[:, [0, -1]] = 255
    tops = [y for _, y, w, _, area in shapes.frames_of(calm(white, False, reach)) if area > BAR_AREA and w / a.shape[1] > BAR_WIDTH and y / a.shape[0] > BAR_FROM]
    return a[: max(tops)] if tops else a


def dead_space(a: np.ndarray) -> tuple[int, int]:
    """Where the left side's dead space ends and the right side's begins: even areas from the middle of a side that are over 100
    pixels wide and as high as the image."""
    left, right = 0, a.shape[1] - 1
    middle = a.shape[0] // 2
    for x in (min(1, a.shape[1] - 1), a.shape[1] - 1):
        same = a == a[middle, x]
        # where no row has two of the grey side by side, the area can't go on to the next column; rows likewise
        ends = np.flatnonzero(~(same[:, 1:] & same[:, :-1]).any(0))
        k = int(np.searchsorted(ends, x))
        first, last = int(ends[k - 1]) + 1 if k else 0, int(ends[k]) if k < len(ends) else a.shape[1] - 1
        same = same[:, first : last + 1]
        if last - first < DEAD_WIDTH or not (same[1:] & same[:-1]).any(1).all():
            continue
        r = shapes.Runs(same, corners=False)
        own = r.label[(r.row == middle) & (r.start <= x - first) & (x - first < r.end)]
        x1, _, w, h, _ = r.boxes()[own[0]].tolist()
        if w > DEAD_WIDTH and h == a.shape[0]:
            left, right = (w, right) if x < a.shape[1] - 1 else (left, x1 + first)
    return left, right


def divisions(a: np.ndarray, left: int, reach: int, least_height: int, share: float, aspect: float) -> list[int]:
    """Where upright areas that are nearly as high as the image begin, each at least `aspect` times the image's height after the one before;
    the last one always counts."""
    at = sorted(x for x, _, _, h, _ in shapes.frames_of(calm(a, True, reach)) if h >= least_height and h / a.shape[0] > share)
    out, start = [], left
    for x in at:
        if x >= left + MARGIN and (x - start) / a.shape[0] >= aspect:
            out.append(x)
            start = x
    return out if not at or at[-1] in out else [*out, at[-1]]


def screens_of(a: np.ndarray, *, reach: int = 5, least_height: int = 20, share: float = 0.9, aspect: float = 1.0) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of the screens of an image, from above and from the left."""
    out = []
    for x1, y1, x2, y2 in rows_of(a, reach):
        row = without_taskbar(a[y1:y2, x1:x2], reach)
        left, right = dead_space(row)
        start = left
        for x in divisions(row, left, reach, least_height, share, aspect):
            if left < x < right:
                if x >= start:
                    out.append((start, y1, x, y2))
                    start = x + 1
                else:
                    start = x
        out.append((start, y1, right, y2))
    return out


def screens(frames: DataFrame, **options) -> DataFrame:
    """(movie_url, frameset, screen, x1, y1, x2, y2): the screens of each frame, numbered from 0. frames: movie_url, frameset, grey,
    width, height (row-major, 0-255; an array of numbers, or bytes); see screens_of() for the options.

    Null images, those without pixels and those whose pixels aren't width * height have none; of frames with equal keys each is told.
    Frames are looked at one by one, where they are: none is shuffled.
    """

    def find(r):
        if r["grey"] is not None and len(r["grey"]) and len(r["grey"]) == r["width"] * r["height"]:
            grey = np.frombuffer(r["grey"], np.uint8) if isinstance(r["grey"], bytes) else r["grey"].astype(np.uint8)
            yield from ((k, *s) for k, s in enumerate(screens_of(grey.reshape(r["height"], r["width"]), **options)))

    # null images are passed over in find(): a filter would make pixels that a query draws a second time
    return each_image(frames.select("movie_url", "frameset", "grey", "width", "height"), ["movie_url", "frameset"], find, "screen int, x1 int, y1 int, x2 int, y2 int")
