"""Areas that follow from matches: zones beside anchors, selected areas, grown areas, gates and filters.

Rectangles are x, y, w, h; FRAME is (movie_url, frameset). Null coordinates give null areas; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.boxes import bounding_box, exterior
from veilframe.operators.sets import FRAME, containing

BIG = 9999


def app_gate(matches: DataFrame, app: str) -> DataFrame:
    """Matches of the framesets that a scanner of an app looks at: all but those where every match names an app, none this one."""
    by = matches.groupBy(*FRAME).agg(F.bool_and(F.col("app_id").isNotNull()).alias("all"), F.bool_or(F.coalesce(F.col("app_id") == app, F.lit(False))).alias("own"))
    return matches.join(by.where("own or not all").select(*FRAME), list(FRAME), "left_semi")


def any_of(column: str, operator: str, values: list) -> Column:
    """equals, in_list or matches_regex_list; other operators are never met, nor are nulls."""
    tests = {"equals": lambda v: F.col(column) == v, "in_list": lambda v: F.col(column) == v, "matches_regex_list": lambda v: F.col(column).rlike(v)}
    if operator not in tests or not values:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, [tests[operator](v) for v in values]), F.lit(False))


def with_scanner_type(matches: DataFrame, kind: str) -> DataFrame:
    """Matches of the framesets that have one of a scanner type."""
    return matches.join(matches.where(F.col("scanner_type") == kind).select(*FRAME).distinct(), list(FRAME), "left_semi")


def normalised(matches: DataFrame) -> DataFrame:
    """location and size from either form: location and size (arrays) win over start and end; adds start and end too."""
    x, y = (F.coalesce(F.col("location")[i], F.col("start")[i]) for i in (0, 1))
    w = F.coalesce(F.when(F.col("location").isNotNull(), F.col("size")[0]), F.col("end")[0] - F.col("start")[0])
    h = F.coalesce(F.when(F.col("location").isNotNull(), F.col("size")[1]), F.col("end")[1] - F.col("start")[1])
    flat = matches.select("*", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.when(F.col("location").isNotNull(), "location").otherwise("start").alias("geom_src"))
    return flat.withColumn("location", F.array("x", "y")).withColumn("size", F.array("w", "h")).withColumn("start", F.array("x", "y")).withColumn("end", F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h")))


def tier_2(matches: DataFrame, anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """Where the mask zones of a template lie beside its matches (anchor_id, scale); whole pixels, cut towards 0.

    anchors: anchor (an id that is part of a match's anchor_id; of several the largest counts), ax, ay. zones: ord, zone_anchor
    (null: of every anchor), x1, y1, x2, y2; the last one counts. Matches without an anchor or a zone are left out.

    A template has few anchors, and each of them many matches: these stay where they are, and the anchors' zones are broadcast.
    """
    of = containing(matches.select("anchor_id").distinct(), "anchor_id", anchors, "anchor")
    of = of.groupBy("anchor_id").agg(F.max_by(F.struct("anchor", "ax", "ay"), "anchor").alias("a")).select("anchor_id", "a.*")
    general = zones.where("zone_anchor is null").agg(F.max(F.struct("ord", "x1", "y1", "x2", "y2")).alias("g"))
    own = zones.where("zone_anchor is not null").groupBy("zone_anchor").agg(F.max(F.struct("ord", "x1", "y1", "x2", "y2")).alias("z"))
    zoned = of.join(own, F.col("anchor_id") == F.col("zone_anchor"), "left")
    rows = matches.join(F.broadcast(zoned), "anchor_id").join(F.broadcast(general), F.lit(True), "left")
    rows = rows.withColumn("z", F.when(F.col("g").isNull() | (F.col("z.ord") > F.col("g.ord")), F.col("z")).otherwise(F.col("g"))).where("z is not null")
    cut = lambda e: F.expr(f"cast({e} as int)")
    return rows.select(*FRAME, "uid", cut("x + (z.x1 - ax) / scale").alias("x"), cut("y + (z.y1 - ay) / scale").alias("y"), cut("(z.x2 - z.x1) / scale").alias("w"), cut("(z.y2 - z.y1) / scale").alias("h"))


def first_eligible(matches: DataFrame, app: str | None) -> DataFrame:
    """Each frameset's first match (by uid) that names no app or this one."""
    ok = matches.where(F.col("app_id").isNull() | (F.col("app_id") == app)) if app else matches
    rest = [c for c in matches.columns if c not in FRAME]
    return ok.groupBy(*FRAME).agg(F.min_by(F.struct(*rest), "uid").alias("m")).select(*FRAME, "m.*")


def shifted_window(framesets: DataFrame, matches: DataFrame, start: tuple[int, int], end: tuple[int, int], origin: tuple[int, int], app: str | None = None) -> DataFrame:
    """The window (x1, y1, x2, y2) that text is looked for in: a selected area replaces it, another match moves it along."""
    m = first_eligible(matches, app).select(*FRAME, "scanner_type", "x", "y", "w", "h")
    own = F.col("scanner_type") == "selected_area"
    dx, dy = F.coalesce(F.col("x") - origin[0], F.lit(0)), F.coalesce(F.col("y") - origin[1], F.lit(0))
    pick = lambda a, b: F.when(own, a).otherwise(b).cast("int")
    rows = framesets.select(*FRAME).distinct().join(m, list(FRAME), "left")
    return rows.select(*FRAME, pick(F.col("x"), dx + start[0]).alias("x1"), pick(F.col("y"), dy + start[1]).alias("y1"), pick(F.col("x") + F.col("w"), dx + end[0]).alias("x2"), pick(F.col("y") + F.col("h"), dy + end[1]).alias("y2"))


def common_area(matches: DataFrame) -> DataFrame:
    """What lies in all rectangles of a frameset (edges included); framesets where nothing does are left out."""
    by = matches.groupBy(*FRAME).agg(F.max("x").alias("x1"), F.max("y").alias("y1"), F.min(F.expr("x + w")).alias("x2"), F.min(F.expr("y + h")).alias("y2"))
    return by.where("x1 <= x2 and y1 <= y2")


def manual_areas(framesets: DataFrame, zones: DataFrame, limit: int = 10_000) -> DataFrame:
    """Hand-drawn zones on every frameset. Zones are counted: more than the limit are an error, fewer are broadcast."""
    n = zones.count()
    if n > limit:
        raise ValueError(f"{n} zones were drawn by hand; at most {limit} are taken")
    return framesets.select(*FRAME).distinct().join(F.broadcast(zones), F.lit(True))


def full_screens(framesets: DataFrame) -> DataFrame:
    """The whole frame of each frameset; frames of unknown width or height (null) are taken for 9999 pixels."""
    return framesets.select(*FRAME, F.lit(0).alias("x"), F.lit(0).alias("y"), F.coalesce("width", F.lit(BIG)).alias("w"), F.coalesce("height", F.lit(BIG)).alias("h"))


def to_exterior(matches: DataFrame, width: int, height: int) -> DataFrame:
    """Interior to exterior: a frameset's only region becomes the four boxes around it; of several regions all stay (side null)."""
    n = F.count("*").over(Window.partitionBy(*FRAME))
    counted = matches.withColumn("__n", n)
    stay = counted.where("__n > 1").select(*FRAME, "uid", F.lit(None).cast("int").alias("side"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.expr("x + w").alias("x2"), F.expr("y + h").alias("y2"))
    return exterior(counted.where("__n = 1"), width, height).select(*stay.columns).unionByName(stay)


def clip_to_zones(matches: DataFrame, zones: DataFrame) -> DataFrame:
    """Matches cut to each of the largest zones allowed (zone, x1, y1, x2, y2) that they overlap; the others go. Zones are few."""
    z = F.broadcast(zones.limit(10_000)) if zones.count() <= 10_000 else zones
    both = matches.join(z, F.expr("x < x2 and x + w > x1 and y < y2 and y + h > y1"))
    return both.selectExpr(*FRAME, "uid", "zone", "greatest(x, x1) x", "greatest(y, y1) y", "least(x + w, x2) - greatest(x, x1) w", "least(y + h, y2) - greatest(y, y1) h")


def scaled_point(px: int, py: int, origin: tuple[int, int]) -> tuple[Column, Column]:
    """Where a point drawn beside an origin lies beside a match (x, y, scale): distances shrink with the scale, whole pixels down."""
    near = lambda p, o: F.when(F.col("scale") == 1, F.lit(p)).otherwise(F.floor(o + (p - o) / F.col("scale")))
    return (near(px, origin[0]) + F.col("x") - origin[0]).cast("int"), (near(py, origin[1]) + F.col("y") - origin[1]).cast("int")


def minimum_zones(matches: DataFrame, zone: tuple[int, int, int, int], origin: tuple[int, int]) -> DataFrame:
    """A zone that is always taken, beside each match; its size is divided by the scales of this and all earlier matches."""
    x1, y1, x2, y2 = zone
    x, y = scaled_point(x1, y1, origin)
    upto = Window.partitionBy(*FRAME).orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shrink = F.product(F.coalesce("scale", F.lit(1.0))).over(upto)
    rows = matches.withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return rows.select(*FRAME, "uid", x.alias("x0"), y.alias("y0"), F.round((x2 - x1) / shrink, 4).alias("w0"), F.round((y2 - y1) / shrink, 4).alias("h0")).toDF(*FRAME, "uid", "x", "y", "w", "h")


def everything(matches: DataFrame, direction: str, width: int, height: int, *, as_wide: bool = False) -> DataFrame:
    """All north, south, east or west of each frameset's first match (by uid), as wide as the frame or as the match; empty ones go."""
    m = first_eligible(matches, None)
    side = {"north": ("0", "0", f"{width}", "y"), "south": ("0", "y + h", f"{width}", f"{height}"), "east": ("x + w", "0", f"{width}", f"{height}"), "west": ("0", "0", "x", f"{height}")}[direction]
    if as_wide:
        side = ("x", side[1], "x + w", side[3]) if direction in ("north", "south") else (side[0], "y", side[2], "y + h")
    return m.selectExpr(*FRAME, "uid", *[f"{e} {n}" for e, n in zip(side, ("x1", "y1", "x2", "y2"), strict=True)]).where("x1 <> x2 and y1 <> y2")


def growth_roi(areas: DataFrame, direction: str, width: int, height: int, offsets: dict[str, int]) -> DataFrame:
    """The region (x1, y1, x2, y2) that an area may grow into: from its edge to the frame's, wider by the offsets."""
    o = {"north": 0, "south": 0, "east": 0, "west": 0} | offsets
    across, down = (f"x - {o['west']}", f"x + w + {o['east']}"), (f"y - {o['north']}", f"y + h + {o['south']}")
    x1, y1, x2, y2 = {"south": (across[0], "y + h", across[1], f"{height}"), "north": (across[0], "0", across[1], "y"), "east": ("x + w", down[0], f"{width}", down[1]), "west": ("0", down[0], "x", down[1])}[direction]
    return areas.selectExpr(*FRAME, "uid area", f"{x1} x1", f"{y1} y1", f"{x2} x2", f"{y2} y2")


def inside_roi(matches: DataFrame, rois: DataFrame) -> DataFrame:
    """Matches that lie wholly in a region of their frameset (edges included), with the region's area."""
    return matches.join(rois, list(FRAME)).where("x between x1 and x2 and y between y1 and y2 and x + w between x1 and x2 and y + h between y1 and y2")


def captured(areas: DataFrame, templates: DataFrame, direction: str, width: int, height: int, offsets: dict[str, int], *, merge: bool = False) -> DataFrame:
    """Areas grown to the first template match (by uid) that overlaps their region, in one direction; others are left out.

    merge: the new area holds the old one.
    """
    rois = growth_roi(areas, direction, width, height, offsets)
    t = templates.select(*FRAME, F.col("uid").alias("t_uid"), *[F.col(c).alias(f"t_{c}") for c in "xywh"])
    hits = rois.join(t, list(FRAME)).where("t_x <= x2 and t_y <= y2 and t_x + t_w >= x1 and t_y + t_h >= y1")
    first = hits.groupBy(*FRAME, "area").agg(F.min_by(F.struct("t_uid", "t_x", "t_y", "t_w", "t_h"), "t_uid").alias("t"))
    both = areas.withColumnRenamed("uid", "area").join(first, [*FRAME, "area"])
    near, far = {"south": ("y" if merge else "y + h", "t.t_y + t.t_h"), "north": ("t.t_y", "y + h" if merge else "y"), "east": ("x" if merge else "x + w", "t.t_x + t.t_w"), "west": ("t.t_x", "x + w" if merge else "x")}[direction]
    box = ("x", near, "w", f"{far} - ({near})") if direction in ("north", "south") else (near, "y", f"{far} - ({near})", "h")
    return both.selectExpr(*FRAME, "area", "t.t_uid template", *[f"{e} {n}" for e, n in zip(box, ("x0", "y0", "w0", "h0"), strict=True)]).toDF(*FRAME, "area", "template", "x", "y", "w", "h")


def within_regions(matches: DataFrame, regions: DataFrame) -> DataFrame:
    """Matches whose first corner lies in some region of their frameset; framesets without regions lose theirs."""
    r = regions.select(*FRAME, *[F.col(c).alias(f"r_{c}") for c in "xywh"])
    hit = matches.select(*FRAME, "uid", "x", "y").join(r, list(FRAME)).where("x between r_x and r_x + r_w and y between r_y and r_y + r_h").select(*FRAME, "uid").distinct()
    return matches.join(hit, [*FRAME, "uid"], "left_semi")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matches of the left side that overlap some of the right one in their frameset (edges included)."""
    r = right.select(*FRAME, *[F.col(c).alias(f"r_{c}") for c in "xywh"])
    hit = left.select(*FRAME, "uid", "x", "y", "w", "h").join(r, list(FRAME)).where("x <= r_x + r_w and r_x <= x + w and y <= r_y + r_h and r_y <= y + h").select(*FRAME, "uid").distinct()
    return left.join(hit, [*FRAME, "uid"], "left_semi")


#: Spread (percent) and number of the scales that a template is looked for in, by name (fixed values).
SCALES = {
    "+/-10/1": (10, 11), "+/-10/5": (10, 5), "+/-20/1": (20, 21), "+/-20/5": (20, 9), "+/-20/10": (20, 5), "+/-25/1": (25, 51),
    "+/-25/5": (25, 11), "+/-40/1": (40, 81), "+/-40/5": (40, 17), "+/-50/1": (50, 101), "+/-50/5": (50, 21), "+/-50/10": (50, 11),
}


def scale_ladder(templates: DataFrame) -> DataFrame:
    """Templates (scale: a name) with a row for each scale to try, the largest first (rung 0); unknown names: 1 alone."""
    ladder = F.lit(None)
    for name, (spread, n) in SCALES.items():
        steps = f"transform(sequence({n - 1}, 0), i -> round(1 - {spread} / 100.0D + i * ({2 * spread} / 100.0D / {n - 1}), 6))"
        ladder = F.when(F.col("scale") == name, F.expr(steps)).otherwise(ladder)
    return templates.select("*", F.posexplode(F.coalesce(ladder, F.array(F.lit(1.0)))).alias("rung", "factor"))


def match_threshold(percent: str, *, strict: bool = True) -> Column:
    """Least correlation of a match from a text: whole percents or 0 and 1; other texts 0.9. Not strict: fractions count too."""
    whole = F.expr(f"try_cast(case when trim({percent}) rlike '^[+-]?[0-9]+$' then trim({percent}) end as int)")
    value = F.when(whole > 1, whole / 100.0).when(whole.isNotNull(), whole.cast("double"))
    part = F.lit(None).cast("double") if strict else F.expr(f"try_cast({percent} as double)")
    return F.coalesce(value, F.when(part > 1, part / 100).otherwise(part), F.lit(0.9))


def selected_areas(matches: DataFrame, width: int, height: int, *, minimum: tuple[int, int, int, int] | None = None, origin: tuple[int, int] = (0, 0), merge: bool = False, exterior_of: bool = False, zones: DataFrame | None = None) -> DataFrame:
    """(frame, x, y, w, h): a scanner's areas after its rules, in this order: the zone always taken is added, all are merged into
    one box, the inside is turned out, and what remains is cut to the largest zones allowed."""
    areas = matches.select(*FRAME, "uid", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    if minimum:
        extra = minimum_zones(matches if "scale" in matches.columns else matches.withColumn("scale", F.lit(1.0)), minimum, origin)
        areas = areas.unionByName(extra.select(*FRAME, "uid", *[F.col(c).cast("double").alias(c) for c in "xywh"]))
    if merge:
        areas = bounding_box(areas).withColumn("uid", F.lit(0).cast(dict(matches.dtypes)["uid"]))
    if exterior_of:
        boxes = to_exterior(areas, width, height)
        areas = boxes.select(*FRAME, "uid", F.col("x1").alias("x"), F.col("y1").alias("y"), F.expr("x2 - x1").alias("w"), F.expr("y2 - y1").alias("h"))
    if zones is not None:
        areas = clip_to_zones(areas, zones)
    return areas.select(*FRAME, "x", "y", "w", "h")
