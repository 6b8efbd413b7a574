"""Selected areas that grow in one direction: to a template, over a grid of texts, or over colours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import boxes, layout, regions, shapes
from veilframe.operators.grouped import in_groups
from veilframe.operators.sets import FRAME

MODES, DIRECTIONS, BUILDS = ("template_capture", "capture_grid", "color_projection"), ("north", "south", "east", "west"), ("near_flood", "furthest_edge", "contours")
#: Pixels by which edges may differ on a grid, and the width of its bins (fixed values).
TOLERANCE, BIN = 10, 10


def over_grid(areas: DataFrame, texts: DataFrame, direction: str, width: int, height: int, offsets: dict[str, int], threshold: int, *, merge: bool = False, tie: bool = False) -> DataFrame:
    """(frame, uid, x, y, w, h): each area grown over the grid that the texts in its region stand on.

    Of the texts wholly in the region those count that share an edge with another one; bins of 10 pixels that hold `threshold` edges are
    the grid's columns and rows, and the grid reaches from its first to its last column, over the rows of the dominant spacing. Areas
    without columns or rows don't grow. tie: the grid begins where the area ends. merge: with the area itself, by direction.
    """
    # a region is a group of its own, so that the areas of a frameset don't see each other's texts
    rois = regions.growth_roi(areas, direction, width, height, offsets)
    own = regions.inside_roi(texts.select(*FRAME, "uid", "x", "y", "w", "h"), rois).withColumn("frameset", F.struct("frameset", "area"))
    bins = layout.histogram(boxes.aligned(own.select(*FRAME, "uid", "x", "y", "w", "h"), TOLERANCE), BIN, threshold)
    at = lambda axis: bins.where(F.col("axis") == axis).select(*FRAME, (F.col("bin") * BIN).cast("int").alias("at"))
    a = areas.select("movie_url", F.struct("frameset", F.col("uid").alias("area")).alias("frameset"), "uid", "x", "y", "w", "h")
    grown = layout.grid_areas(a, at("x"), layout.row_spacing(at("y"), list(FRAME), "at"), merge=merge and direction == "south", tie=tie)
    if merge and direction != "south":
        o = a.select(*FRAME, "uid", *[F.col(c).alias(f"a_{c}") for c in "xwh"])
        new = {"north": ("x", "w", "h + a_h"), "east": ("a_x", "w", "h"), "west": ("x", "w + a_w", "h")}[direction]
        grown = grown.join(o, [*FRAME, "uid"]).selectExpr(*FRAME, "uid", f"{new[0]} x", "y", f"{new[1]} w", f"{new[2]} h")
    return grown.select("movie_url", "frameset.frameset", "uid", "x", "y", "w", "h")


def _projected(mask: np.ndarray, direction: str, area: tuple, build: str, least: int) -> list[tuple]:
    """Boxes (x, y, w, h) in a region, from the mask of its wanted colours."""
    x, y, w, h = area
    high, wide = mask.shape
    if build == "near_flood":
        start = {"north": (high - 1, wide // 2), "south": (0, wide // 2), "east": (high // 2, 0), "west": (high // 2, wide - 1)}[direction]
        r = shapes.Runs(mask == mask[start], corners=False)
        seed = np.zeros(mask.shape, bool)
        seed[start] = True
        return [tuple(r.boxes()[np.argmax(r.holding(seed))][:4].tolist())]
    parts = [b[:4] for b in shapes.Runs(mask).boxes().tolist() if b[4] >= least]
    if build == "contours":
        return [tuple(b) for b in parts] if direction == "east" else []
    if not parts:
        return []
    if direction == "north":
        far = min(b[1] for b in parts)
        return [(0, far, w, y - far)]
    if direction == "south":
        return [(0, 0, w, max(b[1] + b[3] for b in parts))]
    if direction == "east":
        return [(0, 0, max(b[0] + b[2] for b in parts), h)]
    far = min(b[0] for b in parts)
    return [(far, 0, x - far, h)]


def over_colours(areas: DataFrame, frames: DataFrame, direction: str, offsets: dict[str, int], ranges: list[tuple[int, int]], build: str = "near_flood", least: int = 1, *, merge: bool = False) -> DataFrame:
    """(frame, uid, n, x, y, w, h): each area grown over the pixels of its region whose grey lies in one of the ranges (both ends included).

    frames: movie_url, frameset, grey, width, height. build: near_flood, the box of the pixels that are alike (in the ranges, or not in them) and
    joined to the middle of the region's near edge; furthest_edge, up to the far side of the furthest spot; contours, a box for each spot
    (eastwards alone), n from 0. Spots have `least` pixels at least. Null images and regions without a pixel give nothing.
    """
    rows = areas.select(*FRAME, "uid", "x", "y", "w", "h").join(frames.where("grey is not null").select(*FRAME, "grey", "width", "height"), list(FRAME))
    o = {k: 0 for k in DIRECTIONS} | offsets

    def find(rows):
        for r in rows:
            if len(r["grey"]) != r["width"] * r["height"] or None in (r["x"], r["y"], r["w"], r["h"]):
                continue
            a = np.array(r["grey"], np.uint8).reshape(r["height"], r["width"])
            x, y, w, h = r["x"], r["y"], r["w"], r["h"]
            left, right, top, bottom = max(0, x - o["west"]), max(0, x + w + o["east"]), max(0, y - o["north"]), max(0, y + h + o["south"])
            part = {"north": a[: max(0, y), left:right], "south": a[max(0, y + h) :, left:right], "east": a[top:bottom, max(0, x + w) :], "west": a[top:bottom, : max(0, x)]}[direction]
            if not part.size:
                continue
            mask = np.zeros(part.shape, bool)
            for low, up in ranges:
                mask |= (part >= low) & (part <= up)
            for n, (bx, by, bw, bh) in enumerate(_projected(mask, direction, (x, y, w, h), build, least)):
                if direction == "north":
                    box = (bx + x, by, bw, bh + merge * h)
                elif direction == "south":
                    box = (x, y, bw, bh + h) if merge else (bx + x, by + y + h, bw, bh)
                elif direction == "east":
                    box = (x, y, bw + w, bh) if merge else (bx + x + w, by + y, bw, bh)
                else:
                    box = (bx, by + y, bw + merge * w, bh)
                yield (r["uid"], n, *box)

    return in_groups(rows, list(FRAME), ["uid"], find, f"uid {dict(areas.dtypes)['uid']}, n int, x int, y int, w int, h int")


def grow(areas: DataFrame, mode: str, direction: str, width: int, height: int, *, texts: DataFrame | None = None, templates: DataFrame | None = None, frames: DataFrame | None = None,
         offsets: dict[str, int] | None = None, merge: bool = False, tie: bool = False, threshold: int = 2, ranges: list[tuple[int, int]] | None = None, build: str = "near_flood", least: int = 1) -> DataFrame:
    """(frame, uid, x, y, w, h): selected areas (frame, uid, x, y, w, h) grown in one direction; uid is the area's.

    mode: template_capture, to the first template match that overlaps the region (regions.captured()); capture_grid, over a grid of texts
    (over_grid()); color_projection, over colours (over_colours()). The region reaches from the area's edge to the frame's, wider by
    the offsets. Areas that find nothing to grow to are left out; without the mode's table none grows.
    """
    if mode not in MODES or direction not in DIRECTIONS or build not in BUILDS:
        raise ValueError(f"unknown way to grow: {mode}, {direction}, {build}")
    o = offsets or {}
    box = [*FRAME, "uid", "x", "y", "w", "h"]
    if mode == "template_capture" and templates is not None:
        grown = regions.captured(areas, templates, direction, width, height, o, merge=merge)
        return grown.withColumnRenamed("area", "uid").select(*box) if "area" in grown.columns else grown.select(*box)
    if mode == "capture_grid" and texts is not None:
        return over_grid(areas, texts, direction, width, height, o, threshold, merge=merge, tie=tie)
    if mode == "color_projection" and frames is not None:
        return over_colours(areas, frames, direction, o, ranges or [], build, least, merge=merge).select(*box)
    return areas.select(*box).limit(0)
