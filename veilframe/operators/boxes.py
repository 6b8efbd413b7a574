"""Rectangles: bounding boxes, exteriors, half planes, clipping, alignment, areas.

Null coordinates are left out of boxes around others, areas, histograms and comparisons; where a rectangle is moved or turned
out, the result is null as well. Repeated rows count as often as they are, but cover no more. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.sets import FRAME


def bounding_box(matches: DataFrame, *keys: str) -> DataFrame:
    """One rectangle around all of a frameset's."""
    by = list(keys or FRAME)
    box = matches.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.expr("x + w")).alias("x2"), F.max(F.expr("y + h")).alias("y2"))
    return box.selectExpr(*by, "x", "y", "x2 - x w", "y2 - y h")


def exterior(matches: DataFrame, width: int, height: int) -> DataFrame:
    """The four rectangles around each match that fill the screen: above, left, right, below."""
    box = lambda *v: "named_struct({})".format(", ".join(f"'{n}', {e}" for n, e in zip(("side", "x1", "y1", "x2", "y2"), v, strict=True)))
    sides = f"inline(array({box(0, 0, 0, width, 'y')}, {box(1, 0, 'y', 'x', 'y + h')}, {box(2, 'x + w', 'y', width, 'y + h')}, {box(3, 0, 'y + h', width, height)}))"
    return matches.select(*FRAME, "uid", F.expr(sides))


def half_plane(matches: DataFrame, direction: str, width: int, height: int) -> DataFrame:
    """Everything north, south, east or west of each match; none of no area."""
    x, y, w, h = {"north": ("0", "0", width, "y"), "south": ("0", "y + h", width, f"{height} - y - h"), "east": ("x + w", "0", f"{width} - x - w", height), "west": ("0", "0", "x", height)}[direction]
    return matches.selectExpr(*FRAME, "uid", f"{x} x0", f"{y} y0", f"{w} w0", f"{h} h0").where("w0 > 0 and h0 > 0").selectExpr(*FRAME, "uid", "x0 x", "y0 y", "w0 w", "h0 h")


def clip(matches: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Matches cut to a zone; those outside go."""
    return matches.where(f"x < {x2} and x + w > {x1} and y < {y2} and y + h > {y1}").selectExpr(
        *FRAME, "uid", f"greatest(x, {x1}) x", f"greatest(y, {y1}) y", f"least(x + w, {x2}) - greatest(x, {x1}) w", f"least(y + h, {y2}) - greatest(y, {y1}) h"
    )


def aligned(matches: DataFrame, tolerance: int) -> DataFrame:
    """Matches that share their top, left or right edge with another of the frameset, within a tolerance.

    In the order of their edges the nearest other edge is the one before or the one after, so no pairs are made. Null edges are
    aligned with nothing.
    """
    edge = "inline(array({}))".format(", ".join(f"named_struct('kind', '{k}', 'at', {e})" for k, e in (("y", "y"), ("x", "x"), ("x2", "x + w"))))
    e = matches.select(*FRAME, "uid", F.expr(edge)).where("at is not null").distinct()
    up, down = (Window.partitionBy(*FRAME, "kind").orderBy(*o) for o in (("at", "uid"), (F.col("at").desc(), F.col("uid").desc())))
    e = e.withColumn("low", F.when(F.lag("uid").over(up) != F.col("uid"), F.lag("at").over(up))).withColumn("high", F.when(F.lag("uid").over(down) != F.col("uid"), F.lag("at").over(down)))
    last = lambda c, by: F.last(c, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = (F.col("at") - last("low", up) <= tolerance) | (last("high", down) - F.col("at") <= tolerance)
    hits = e.withColumn("near", F.coalesce(near, F.lit(False))).where("near").select(*FRAME, "uid").distinct()
    return matches.join(hits, [*FRAME, "uid"], "left_semi")


def within(matches: DataFrame, regions: DataFrame) -> DataFrame:
    """Matches whose centre lies in some region (x, y, w, h) of their frameset, borders included."""
    r = regions.select(*FRAME, *[F.col(c).alias(f"r_{c}") for c in "xywh"])
    inside = F.expr("2 * x + w between 2 * r_x and 2 * (r_x + r_w) and 2 * y + h between 2 * r_y and 2 * (r_y + r_h)")
    m, r = matches.alias("m"), r.alias("r")
    return m.join(r, (F.col("m.movie_url") == F.col("r.movie_url")) & (F.col("m.frameset") == F.col("r.frameset")) & inside, "left_semi")


def position_histogram(matches: DataFrame, width: int, at_least: int) -> DataFrame:
    """Bins of left and right edges with enough of them."""
    return matches.select("movie_url", F.explode(F.array("x", F.expr("x + w"))).alias("at")).where("at is not null").groupBy("movie_url", F.expr(f"at div {width}").alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def project_zone(matches: DataFrame, anchor: tuple[int, int], zone: tuple[int, int, int, int], scale: str) -> DataFrame:
    """Where a zone (x1, y1, x2, y2) drawn beside an anchor lies beside each match found at a scale; whole pixels."""
    (ax, ay), (x1, y1, x2, y2) = anchor, zone
    cut = lambda e: f"cast({e} as int)"
    return matches.selectExpr(*FRAME, "uid", f"{cut(f'x + ({x1 - ax}) / {scale}')} x", f"{cut(f'y + ({y1 - ay}) / {scale}')} y", f"{cut(f'{x2 - x1} / {scale}')} w", f"{cut(f'{y2 - y1} / {scale}')} h")


def union_area(matches: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Pixels that the rectangles of a frameset (or other keys) cover together, both edges included.

    Distinct rectangles are gathered once by key; each strip between two of their upper or lower edges adds its height
    times the runs of x that its rectangles cover, found by a running maximum. Null rectangles are left out.
    """
    k = list(keys)
    rect = F.struct("x", F.expr("x + w + 1").alias("x2"), "y", F.expr("y + h + 1").alias("y2"))
    by = matches.where("x is not null and y is not null and w is not null and h is not null").groupBy(*k).agg(F.array_sort(F.collect_set(rect)).alias("r"))
    by = by.withColumn("ys", F.expr("array_sort(array_distinct(flatten(transform(r, q -> array(q.y, q.y2)))))"))
    covered = "aggregate(filter(r, q -> q.y <= top and q.y2 > top), struct(0 n, cast(-1000000000 as int) e), (s, q) -> struct(s.n + greatest(0, q.x2 - greatest(q.x, s.e)) as n, greatest(s.e, q.x2) as e), s -> s.n)"
    area = f"aggregate(transform(slice(ys, 1, size(ys) - 1), (top, i) -> cast(ys[i + 1] - top as long) * {covered}), 0L, (a, v) -> a + v)"
    return by.select(*k, F.expr(area).alias("area"))


def reading_order(matches: DataFrame) -> DataFrame:
    """place: a match's number in its frameset from above, then from the left; ties by uid, nulls first."""
    return matches.withColumn("place", F.row_number().over(Window.partitionBy(*FRAME).orderBy("y", "x", "uid")))


def largest(matches: DataFrame, value: str) -> DataFrame:
    """Each frameset's match of the largest value; of equal ones the smallest uid. Null values lose."""
    rest = [c for c in matches.columns if c not in FRAME]
    return matches.groupBy(*FRAME).agg(F.max_by(F.struct(*rest), F.struct(F.expr(value).alias("v"), (-F.col("uid")).alias("o"))).alias("m")).select(*FRAME, "m.*")
