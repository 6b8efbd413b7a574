"""Images as arrays of grey values (row-major, 0-255) in rows: masking, meshes of cells, colour regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.grouped import in_groups
from veilframe.operators.shapes import outer_components
from veilframe.operators.templates import correlation, window_sums

#: Rows of an image whose medians are taken together.
STRIP = 32
METHODS = ("black_rectangle", "green_outline", "background_color", "blur_7x7", "blur_21x21", "blur_median")


def _blurred(a: np.ndarray, method: str) -> np.ndarray:
    n = 21 if method == "blur_21x21" else 7
    edge = {"mode": "edge"} if method == "blur_median" else {"mode": "reflect"}
    k = n // 2
    if method != "blur_median" and min(a.shape) <= k:
        edge = {"mode": "symmetric"}
    wide = np.pad(a, k, **edge)
    if method != "blur_median":
        return np.rint(window_sums(wide, n, n) / (n * n)).astype(np.uint8)
    out = np.empty(a.shape, np.uint8)
    for y in range(0, len(a), STRIP):  # a strip at a time: the windows are n * n times the pixels
        view = np.lib.stride_tricks.sliding_window_view(wide[y : y + STRIP + n - 1], (n, n))
        out[y : y + STRIP] = np.partition(view.reshape(*view.shape[:2], n * n), n * n // 2, axis=2)[:, :, n * n // 2]
    return out


def masked(images: DataFrame, regions: DataFrame, method: str) -> DataFrame:
    """Images (image, grey, width, height) with their regions (image, x, y, w, h) masked, in order of ord.

    black_rectangle; green_outline (a line of grey 128, two pixels wide); background_color (the fullest of 32 bins of the
    region, as the number of the bin; regions of no pixels stay); blur_7x7, blur_21x21 (means, mirrored at the borders) and blur_median (7 by 7).
    Rectangles have both edges inside, blurs leave out the far ones. Images without regions stay as they are; null ones stay null.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    one = images.groupBy("image").agg(F.min(F.struct("width", "height", "grey")).alias("i"))
    all_regions = regions.where("x is not null and y is not null and w is not null and h is not null")
    own = all_regions.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("r"))

    def paint(rows):
        for row in rows:
            if row["grey"] is None or len(row["grey"]) != row["width"] * row["height"]:
                yield (row["grey"],)
                continue
            a = np.array(row["grey"], np.uint8).reshape(row["height"], row["width"])
            soft = _blurred(a, method) if method.startswith("blur") and row["r"] else a
            for r in row["r"] or []:
                x, y, x2, y2 = max(0, r["x"]), max(0, r["y"]), r["x"] + r["w"], r["y"] + r["h"]
                if x2 < 0 or y2 < 0:
                    continue
                if method == "black_rectangle":
                    a[y : y2 + 1, x : x2 + 1] = 0
                elif method == "green_outline":
                    inner = a[y + 1 : y2, x + 1 : x2].copy()
                    a[max(0, y - 1) : y2 + 2, max(0, x - 1) : x2 + 2] = 128
                    a[y + 1 : y2, x + 1 : x2] = inner
                elif method == "background_color":
                    part = a[y:y2, x:x2]
                    if part.size:
                        a[y : y2 + 1, x : x2 + 1] = int(np.argmax(np.bincount(part.reshape(-1) // 8, minlength=32)))
                else:
                    a[y:y2, x:x2] = soft[y:y2, x:x2]
            yield (a.reshape(-1).tolist(),)

    rows = one.join(own, "image", "left").select("image", "i.*", "r")
    return in_groups(rows, ["image"], [], paint, "grey array<int>")


def _correlated(target: np.ndarray, cell: np.ndarray) -> tuple[float, int, int]:
    """The best normalised correlation of a cell in an image, and where (x, y): of equal ones the first."""
    h, w = cell.shape
    if target.shape[0] < h or target.shape[1] < w:
        return -1.0, 0, 0
    r = correlation(target, cell)
    at = int(np.argmax(np.round(r, 9)))
    return float(r.reshape(-1)[at]), at % r.shape[1], at // r.shape[1]


def _interest(cell: np.ndarray) -> int:
    """How many bright (over 200) spots a cell has: components, corners included."""
    return len(outer_components(cell > 200))


def mesh_matches(frames: DataFrame, matches: DataFrame, mesh: int, min_score: int, threshold: float = 0.9, tolerance: int = 5) -> DataFrame:
    """(movie_url, place, x, y, w, h, score): frames without a match where the last match before them is found again.

    frames: movie_url, place, grey, width, height; matches: movie_url, place, uid, x, y, w, h (of several in a frame the
    first by uid counts). The matched area is cut into every other cell of mesh * mesh pixels; from the cell with the most
    bright spots on, each is looked for in the frame. Cells found (correlation at least the threshold) whose origins agree with the first found
    one's within the tolerance add their spots to the score; frames of more than min_score get a match at that origin.
    """
    first = matches.groupBy("movie_url", "place").agg(F.min_by(F.struct("x", "y", "w", "h"), "uid").alias("m"))
    f = frames.select("movie_url", "place", "grey", "width", "height").join(first, ["movie_url", "place"], "left")
    before = Window.partitionBy("movie_url").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = F.last(F.when(F.col("m").isNotNull(), F.struct("m", "grey", "width", "height")), ignorenulls=True).over(before)
    todo = f.withColumn("ref", ref).where("m is null and ref is not null and grey is not null and ref.grey is not null")

    def find(rows):
        for row in rows:
            ref, m = row["ref"], row["ref"]["m"]
            src = np.array(ref["grey"], np.uint8).reshape(ref["height"], ref["width"])
            target = np.array(row["grey"], np.uint8).reshape(row["height"], row["width"])
            cells = []
            for j in range((m["h"] // mesh + 1) // 2):
                for i in range((m["w"] // mesh + 1) // 2):
                    x, y = m["x"] + 2 * i * mesh, m["y"] + 2 * j * mesh
                    cell = src[y : y + mesh, x : x + mesh]
                    if cell.size:
                        cells.append((-_interest(cell), j, i, cell))
            origin, score = None, 0
            for spots, j, i, cell in sorted(cells, key=lambda c: c[:3]):
                best, x, y = _correlated(target, cell)
                if best < threshold:
                    continue
                at = (x - 2 * i * mesh, y - 2 * j * mesh)
                origin = origin or at
                if abs(at[0] - origin[0]) <= tolerance and abs(at[1] - origin[1]) <= tolerance:
                    score -= spots
            if origin and score > min_score:
                yield (*origin, m["w"], m["h"], score)

    return in_groups(todo.select("movie_url", "place", "grey", "width", "height", "ref"), ["movie_url", "place"], [], find, "x int, y int, w int, h int, score int")


def colour_regions(images: DataFrame, areas: DataFrame, low: int, high: int, *, least: int = 1) -> DataFrame:
    """(image, x, y, w, h): boxes of the spots of grey low ... high within an area (image, x1, y1, x2, y2; the far edges outside),
    corners joined; those of fewer than `least` pixels' box are left out. Of several areas of an image each is searched."""
    rows = images.where("grey is not null").select("image", "grey", "width", "height").join(areas.select("image", "x1", "y1", "x2", "y2"), "image")

    def boxes(rows):
        for r in rows:
            a = np.array(r["grey"], np.int64).reshape(r["height"], r["width"])
            x, y = max(0, r["x1"]), max(0, r["y1"])
            on = (a[y : max(y, r["y2"]), x : max(x, r["x2"])] >= low) & (a[y : max(y, r["y2"]), x : max(x, r["x2"])] <= high)
            for x1, y1, x2, y2 in sorted(outer_components(on)):
                if (x2 - x1 + 1) * (y2 - y1 + 1) >= least:
                    yield x1 + x, y1 + y, x2 - x1 + 1, y2 - y1 + 1

    return in_groups(rows, ["image"], ["x1", "y1", "x2", "y2"], boxes, "x int, y int, w int, h int")
