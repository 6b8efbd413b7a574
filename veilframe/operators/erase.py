"""Text taken out of parts of an image, so that what lies behind and around it stays: by closing, by edges, by colours; ovals and boxes
drawn around what matters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import shapes
from veilframe.operators.grouped import in_groups

HOW = ("eroded", "edge_partitioned", "color_partitioned")
#: Fixed values of the rules: of lines, of edges' partitions, of colours.
LEAST_LINE, LINE_STRENGTH, LEAST_PARTITION, SHORT_PARTITION, TOP_COLOURS, PADDING, OUTLINE = 20, 100, 400, 10, 20, 10, 128


def background(a: np.ndarray) -> int:
    """The middle of the fullest of 32 bins of grey (of equal ones the darkest)."""
    return int(np.argmax(np.bincount(a.reshape(-1) // 8, minlength=32))) * 8 + 4


def closed(a: np.ndarray, ground: int) -> np.ndarray:
    """Strokes of up to four pixels closed: dark ones on light ground, light ones on dark (up to 127) ground."""
    if ground <= 127:
        return shapes.dilated(shapes.eroded(a, 2, 2), 2, 2)
    return shapes.eroded(shapes.dilated(a, 2, 2), 2, 2)


def lines(a: np.ndarray, reach: int) -> list[tuple[int, int, int, int]]:
    """Boxes of the long horizontal lines: where gradients stay strong over `reach` pixels to both sides; with a line of pixels around,
    from 20 pixels of width and area on. The first and last column count as no line."""
    strong = shapes.dilated(shapes.eroded(shapes.strength(a), reach, 0), 0, 1) > LINE_STRENGTH
    strong[:, [0, -1]] = False
    out = []
    for x, y, w, h, _ in shapes.Runs(strong, corners=False).boxes().tolist():
        x1, y1, x2, y2 = max(0, x - 1), max(0, y - 1), min(a.shape[1], x + w + 1), min(a.shape[0], y + h + 1)
        if (x2 - x1, y2 - y1) != a.shape[::-1] and x2 - x1 >= LEAST_LINE and (w + 1) * (h + 1) >= LEAST_LINE:
            out.append((x1, y1, x2 - x1, y2 - y1))
    return out


def draw_lines(out: np.ndarray, source: np.ndarray, boxes: list, ground: int) -> None:
    """Lines drawn again through the middle of their boxes, a quarter as thick, in the source's grey there; in white on dark
    ground and black on light where that is hardly another grey than the ground (less than 67 off)."""
    for x, y, w, h in boxes:
        middle = y + h // 2
        grey = int(source[min(middle, source.shape[0] - 1), min(x + w // 2, source.shape[1] - 1)])
        if 3 * abs(grey - ground) < 200:
            grey = 255 if ground <= 127 else 0
        thick = max(1, h // 4)
        out[max(0, middle - thick // 2) : middle - thick // 2 + thick, x : x + w + 1] = grey


def colour_ranges(a: np.ndarray, closeness: int = 100) -> list[tuple[int, int, int]]:
    """(grey, low, high) of the groups of the fullest bins: up to TOP_COLOURS of the 32 bins that hold over 1 % of the pixels, from the emptiest
    on; a bin joins the first group whose mean is near enough (3 d^2 at most closeness). Ranges reach PADDING beyond the bins
    and are cut in the middle where two overlap."""
    n = np.bincount(a.reshape(-1) // 8, minlength=32)
    bins = [b for b in sorted(range(32), key=lambda b: (n[b], b))[-TOP_COLOURS:] if n[b] > a.size // 100]
    groups: list[list[int]] = []
    for b in bins:
        own = next((g for g in groups if 3 * (b - sum(g) / len(g)) ** 2 <= closeness), None)
        if own is None:
            groups.append([b])
        else:
            own.append(b)
    out = []
    for g in groups:
        mean = sum(g) / len(g)
        grey, reach = int(mean * 8 + 4), int(np.ceil(max(abs(b - mean) for b in g) * 8))
        out.append([grey, max(0, grey - reach - PADDING), min(255, grey + reach + PADDING)])
    order = sorted(range(len(groups)), key=lambda i: f"{groups[i][0]}-{groups[i][0]}-{groups[i][0]}")  # as names are sorted
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            one, two = out[i], out[j]
            if one[1] <= two[2] <= one[2]:
                half = (two[2] - one[1]) // 2
                one[1], two[2] = one[1] + half, two[2] - half - 1
            elif one[1] <= two[1] <= one[2]:
                half = (one[2] - two[1]) // 2
                two[1], one[2] = two[1] + half, one[2] - half - 1
    return [tuple(x) for x in out]


def by_colours(a: np.ndarray, closeness: int = 100, least: int = 400) -> np.ndarray:
    """Areas of one colour range (closed by three pixels) painted in its middle grey, with holes of fewer than `least` pixels; areas of
    fewer than that, holes included, stay as they are."""
    out = a.copy()
    for grey, low, high in colour_ranges(a, closeness):
        on = ((a >= low) & (a <= high)).astype(np.uint8)
        on = shapes.eroded(shapes.dilated(on * 255, 3, 3), 3, 3) > 0
        gaps = shapes.Runs(~on, corners=False)
        if gaps.n:
            b = gaps.boxes()
            inner = (b[:, 0] > 0) & (b[:, 1] > 0) & (b[:, 0] + b[:, 2] < a.shape[1]) & (b[:, 1] + b[:, 3] < a.shape[0])
            on |= gaps.painted(inner & (b[:, 4] < least), a.shape)
        parts = shapes.Runs(on)
        if parts.n:
            out[parts.painted(parts.boxes()[:, 4] >= least, a.shape)] = grey
    return out


def by_edges(a: np.ndarray, ground: int) -> np.ndarray:
    """The background's grey, with the boxes of edges that touch the border twice in their own background's grey, and the other
    edges as outlines (grey 128). Edges whose box has fewer than 400 pixels, or is narrower than 10 pixels inside of the image, are left out."""
    median = float(np.median(a))
    found = shapes.Runs(shapes.edges(a, int(max(0, 0.67 * median)), int(min(255, 1.33 * median))))
    out = np.full(a.shape, ground, np.uint8)
    if not found.n:
        return out
    high, wide = a.shape
    border = np.zeros(a.shape, bool)
    border[[0, -1]] = border[:, [0, -1]] = True
    keep = np.zeros(found.n, bool)
    boxes = found.boxes().tolist()
    touches = np.zeros(found.n, np.int64)
    for row, start, end, k in zip(found.row, found.start, found.end, found.label):
        touches[k] += int(border[row, start:end].sum())
    rims = []
    for k, (x, y, w, h, _) in enumerate(boxes):
        outer = x == 0 or x + w >= wide - 1 or y == 0 or y + h >= high - 1
        if w * h < LEAST_PARTITION or (w < SHORT_PARTITION and not outer):
            continue
        if touches[k] >= 2:
            rims.append((x, y, w, h))
        else:
            keep[k] = True
    out[found.painted(keep, a.shape)] = OUTLINE
    for x, y, w, h in rims:
        out[y : y + h + 1, x : x + w + 1] = background(a[y : y + h, x : x + w])
    return out


def erased_array(a: np.ndarray, how: str, *, reach: int = 13, closeness: int = 100, least: int = 400, keep_lines: bool = True) -> np.ndarray:
    if not a.size:
        return a
    ground = background(a)
    out = closed(a, ground) if how == "eroded" else by_edges(a, ground) if how == "edge_partitioned" else by_colours(a, closeness, least)
    out = out.copy()
    if keep_lines:
        draw_lines(out, a, lines(a, reach), ground)
    return out


def erased(images: DataFrame, regions: DataFrame, how: str = "eroded", **options) -> DataFrame:
    """Images (image, grey, width, height) whose regions (image, ord, x, y, w, h; far edges outside) have lost their text, in order
    of ord.

    how: eroded (closed()), edge_partitioned (by_edges()) or color_partitioned (by_colours()); afterwards long horizontal lines are drawn
    again (keep_lines). options: reach (of lines), closeness and least (of colours). Regions are cut to the image; null ones and
    those without a pixel change nothing. Images without regions, null images and those whose pixels aren't
    width * height stay as they are; of rows with one image the smallest counts. Empty tables stay empty.
    """
    if how not in HOW:
        raise ValueError(f"unknown way {how}")
    one = images.groupBy("image").agg(F.min(F.struct("width", "height", "grey")).alias("i"))
    good = regions.where("x is not null and y is not null and w is not null and h is not null")
    own = good.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("r"))

    def paint(rows):
        for row in rows:
            if row["grey"] is None or len(row["grey"]) != row["width"] * row["height"]:
                yield (row["grey"],)
                continue
            a = np.array(row["grey"], np.uint8).reshape(row["height"], row["width"])
            for r in row["r"] or []:
                part = (slice(max(0, r["y"]), max(0, r["y"] + r["h"])), slice(max(0, r["x"]), max(0, r["x"] + r["w"])))
                a[part] = erased_array(a[part].copy(), how, **options)
            yield (a.reshape(-1).astype(np.int32),)

    return in_groups(one.join(own, "image", "left").select("image", "i.*", "r"), ["image"], [], paint, "grey array<int>", arrays=True)


def illustrated_array(a: np.ndarray, kind: str, box: tuple[int, int, int, int], *, grey: int = 128, line: int = 5, shade: bool = False, ratio: float = 0.5) -> np.ndarray:
    """An oval (center x, y, radii) or a box (x, y, far x, y inside) drawn as a line of the given width, half of it on either side; with
    shade, what lies outside is darkened to 1 - ratio."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    p, q, r, s = box
    if kind == "oval":
        within = lambda more: (r + more > 0) & (s + more > 0) & ((x - p) ** 2 * max(s + more, 0) ** 2 + (y - q) ** 2 * max(r + more, 0) ** 2 <= (max(r + more, 0) * max(s + more, 0)) ** 2)
    else:
        within = lambda more: (x >= p - more) & (x <= r + more) & (y >= q - more) & (y <= s + more)
    out = a.copy()
    if shade:
        out = np.where(within(0), a, np.rint(a * (1 - ratio))).astype(np.uint8)
    out[within(line / 2) & ~within(-line / 2)] = grey
    return out


def illustrated(images: DataFrame, marks: DataFrame, *, line: int = 5, shade: bool = False, ratio: float = 0.5) -> DataFrame:
    """Images (image, grey, width, height) with their marks drawn in order of ord: (image, ord, kind, a, b, c, d, colour).

    kind oval: center (a, b) and radii c, d; box: corners (a, b) and (c, d), both inside; other kinds and null numbers draw nothing. See
    illustrated_array() for line, shade and ratio. Null images and those whose pixels aren't width * height stay as they are.
    """
    one = images.groupBy("image").agg(F.min(F.struct("width", "height", "grey")).alias("i"))
    good = marks.where("kind in ('oval', 'box') and a is not null and b is not null and c is not null and d is not null")
    own = good.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "a", "b", "c", "d", F.coalesce("colour", F.lit(128)).alias("colour")))).alias("m"))

    def paint(rows):
        for row in rows:
            if row["grey"] is None or len(row["grey"]) != row["width"] * row["height"]:
                yield (row["grey"],)
                continue
            a = np.array(row["grey"], np.uint8).reshape(row["height"], row["width"])
            for m in row["m"] or []:
                a = illustrated_array(a, m["kind"], (m["a"], m["b"], m["c"], m["d"]), grey=m["colour"], line=line, shade=shade, ratio=ratio)
            yield (a.reshape(-1).astype(np.int32),)

    return in_groups(one.join(own, "image", "left").select("image", "i.*", "m"), ["image"], [], paint, "grey array<int>", arrays=True)
