"""What changed between one frameset's recognised text and the next one's, and where that is."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.text import indel_ratio
from veilframe.operators.grouped import in_groups, rows_of
from veilframe.functions.text import repair_digits
from veilframe.operators.sets import FRAME

CENTRE = ("x + cast(w div 2 as int)", "y + cast(h div 2 as int)")


def in_order(matches: DataFrame, by: str = "frameset") -> DataFrame:
    """place: the number of a match's frameset among those of its movie that have matches, so that empty ones are skipped."""
    sets = matches.select(*FRAME, by).distinct() if by not in FRAME else matches.select(*FRAME).distinct()
    return matches.join(sets.withColumn("place", F.row_number().over(Window.partitionBy("movie_url").orderBy(by, "frameset"))), list(FRAME))


def changed_text(matches: DataFrame, threshold: int = 70) -> DataFrame:
    """(movie_url, frameset, uid, state) of the text that changed since the frameset before: new, altered or disappeared.

    A text of the frameset before is found again in the last (by uid) current one whose rectangle holds its centre; it
    is altered if they are less similar than the threshold, else unchanged. Current ones that hold no earlier centre
    are new. Disappeared ones are told with the current frameset. A movie's first frameset is all new. Null texts are
    similar to nothing. Each frameset is told the next one, so that rows are joined by framesets alone.
    """
    m = matches.where("movie_url is not null and frameset is not null").select(*FRAME, "uid", "text", "x", "y", "w", "h")
    ahead = m.select(*FRAME).distinct().withColumn("next", F.lead("frameset").over(Window.partitionBy("movie_url").orderBy("frameset"))).where("next is not null")
    before = m.join(ahead, list(FRAME)).selectExpr("movie_url", "next frameset", "uid b_uid", "text b_text", f"{CENTRE[0]} cx", f"{CENTRE[1]} cy")
    held = before.join(m, list(FRAME)).where("cx between x and x + w and cy between y and y + h")
    last = held.groupBy(*FRAME, "b_uid").agg(F.max_by(F.struct("uid", "text", "b_text"), "uid").alias("c")).select(*FRAME, "b_uid", F.col("c.uid").alias("uid"), F.col("c.text").alias("t"), F.col("c.b_text").alias("b"))
    alike = F.coalesce(indel_ratio("b", "t"), F.lit(0)) >= threshold
    kept = last.withColumn("altered", ~alike).groupBy(*FRAME, "uid").agg(F.bool_or("altered").alias("altered"))
    now = m.join(kept, [*FRAME, "uid"], "left").where("altered is null or altered").select(*FRAME, "uid", F.when(F.col("altered"), "altered").otherwise("new").alias("state"))
    gone = before.join(last.select(*FRAME, "b_uid"), [*FRAME, "b_uid"], "left_anti")
    return now.unionByName(gone.select(*FRAME, F.col("b_uid").alias("uid"), F.lit("disappeared").alias("state")))


def on_one_screen(matches: DataFrame, screens: DataFrame) -> DataFrame:
    """Matches of the screen that holds the most centres (of several the first), where more than one holds any; else all.

    screens: frameset, screen (number), x1, y1, x2, y2. Framesets without screens keep all.
    """
    inside = matches.join(screens, list(FRAME)).where(f"{CENTRE[0]} between x1 and x2 and {CENTRE[1]} between y1 and y2").select(*FRAME, "uid", "screen")
    count = inside.groupBy(*FRAME, "screen").agg(F.count("*").alias("n"))
    best = count.groupBy(*FRAME).agg(F.min_by("screen", F.struct(-F.col("n"), "screen")).alias("screen"), F.count("*").alias("used")).where("used > 1").drop("used")
    kept = inside.join(best, [*FRAME, "screen"], "left_semi").select(*FRAME, "uid").distinct()
    free = matches.join(best.select(*FRAME), list(FRAME), "left_anti")
    return free.unionByName(matches.join(best.select(*FRAME), list(FRAME), "left_semi").join(kept, [*FRAME, "uid"], "left_semi"))


def effective_windows(matches: DataFrame) -> DataFrame:
    """The window (x1, y1, x2, y2) around all changed fields of a frameset."""
    return matches.groupBy(*FRAME).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.expr("x + w")).alias("x2"), F.max(F.expr("y + h")).alias("y2"))


def without_hotspots(matches: DataFrame, width: int, height: int, *, bins: int = 8, least_pixels: int = 100, ratio: float = 2.0, most: int = 255) -> DataFrame:
    """Matches but for those whose centre lies where things change all the time (a clock, a cursor).

    For each movie the framesets that cover a pixel are counted (up to 255) and scaled to the brightest; the histogram of brightness
    in equal bins is searched downwards for a trough below the top bin (a bin that the top one exceeds by the ratio, right
    beneath it); brightness from the trough's upper end on is hot. Without enough top pixels or a trough nothing is hot.

    Framesets are dealt out over all tasks, each of which counts a movie's pixels in a mask of width * height numbers and hands
    it on packed; a movie's masks are then added up one after the other, and its hot pixels joined to the centres by lines of the screen.
    """
    ok = matches.where("movie_url is not null and frameset is not null and uid is not null and x is not null and y is not null and w is not null and h is not null")

    def count(batches):
        heat = stamp = movie = frameset = None
        mark = 0
        for r in rows_of(batches):
            if r["movie_url"] != movie:
                if heat is not None:
                    yield _packed(movie, heat)
                heat, stamp, mark, movie, frameset = np.zeros((height, width), np.int32), np.zeros((height, width), np.int32), 0, r["movie_url"], None
            if r["frameset"] != frameset:
                mark, frameset = mark + 1, r["frameset"]
            at = (slice(max(0, r["y"]), max(0, r["y"] + r["h"] + 1)), slice(max(0, r["x"]), max(0, r["x"] + r["w"] + 1)))
            seen = stamp[at]
            heat[at] += seen != mark  # a frameset counts once, however many of its rectangles cover a pixel
            seen[...] = mark
        if heat is not None:
            yield _packed(movie, heat)

    def hot(rows):
        heat = np.zeros((height, width), np.uint8)
        for r in rows:
            own = np.frombuffer(zlib.decompress(r["mask"]), np.uint8).reshape(height, width)
            np.minimum(heat.astype(np.uint16) + own, 255, out=heat, casting="unsafe")
        heat = heat * (most // max(1, int(heat.max())))
        hist = np.bincount(heat.reshape(-1).astype(np.int64) * bins // (most + 1), minlength=bins)
        cut = None
        if hist[bins - 1] >= least_pixels:
            for i in range(bins - 2, 0, -1):
                if not hist[i] or not hist[bins - 1] / hist[i] > ratio:
                    break
                cut = (i + 1) * most / bins if cut is None else cut
        for y in range(height if cut is not None else 0):
            if (heat[y] >= cut).any():
                yield y, (heat[y] >= cut).tobytes()

    parts = ok.select(*FRAME, "x", "y", "w", "h").repartition(*FRAME).sortWithinPartitions(*FRAME).mapInArrow(count, "movie_url string, mask binary")
    lines = in_groups(parts, ["movie_url"], [], hot, "cy int, line binary")
    centre = lambda at, size, most: F.expr(f"cast(greatest(0, least({most - 1}, {at} + cast(floor({size} / 2) as int))) as int)")
    spots = ok.withColumn("__cx", centre("x", "w", width)).withColumn("__cy", centre("y", "h", height))
    own = lines.select("movie_url", F.col("cy").alias("__cy"), "line")
    cool = spots.join(own, ["movie_url", "__cy"], "left").where("line is null or substring(line, __cx + 1, 1) = X'00'")
    return cool.select(*matches.columns)


def _packed(movie: str, heat: np.ndarray) -> pa.RecordBatch:
    mask = zlib.compress(np.minimum(heat, 255).astype(np.uint8).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([movie], pa.string()), pa.array([mask], pa.binary())], names=["movie_url", "mask"])


def roll_over(frames: DataFrame) -> DataFrame:
    """(movie_url, place, minute, second): where a clock's minute first changes between neighbouring frames, and what
    time of the hour the recording began: frames (movie_url, place: second from the start, minute: what the clock shows, or null)."""
    before = F.lag("minute").over(Window.partitionBy("movie_url").orderBy("place"))
    rolled = frames.withColumn("b", before).where("minute = b + 1 or minute = 0 and b = 59")
    first = rolled.groupBy("movie_url").agg(F.min_by("minute", "place").alias("m"), F.min("place").alias("place"))
    start = F.pmod(F.col("m") * 60 - F.col("place"), F.lit(3600))
    return first.select("movie_url", "place", F.floor(start / 60).cast("int").alias("minute"), (start % 60).cast("int").alias("second"))


def blue_screen_time(texts: DataFrame) -> DataFrame:
    """(movie_url, hour, minute, second, am_pm) of the first text (by ord) that shows a time of the form 1:02:03 PM."""
    hit = texts.where(F.col("text").rlike(r"(\d+):(\d+):(\d+) [A|P]M")).groupBy("movie_url").agg(F.min_by("text", "ord").alias("t"))
    part = lambda i: F.regexp_extract("t", r"(\d+):(\d+):(\d+) ([A|P])M", i)
    return hit.select("movie_url", part(1).alias("hour"), part(2).alias("minute"), part(3).alias("second"), F.concat(part(4), F.lit("M")).alias("am_pm"))


def bar_minutes(texts: DataFrame) -> DataFrame:
    """(movie_url, place, minute): what the taskbar's clock shows in each frame, null if nothing there looks like one.

    texts: movie_url, place, ord, text. The first text (by ord) of the form 12:34 PM counts, after look-alikes of digits are repaired.
    """
    shown = F.regexp_extract(repair_digits("text"), r"(\w*)(:?)(\d\d)(\s*)(\S)M", 3)
    t = texts.withColumn("shown", F.when(F.length(shown) > 0, shown.cast("int")))
    return t.groupBy("movie_url", "place").agg(F.min_by("shown", F.when(F.col("shown").isNotNull(), F.col("ord"))).alias("minute"))


def start_times(screens: DataFrame, bars: DataFrame) -> DataFrame:
    """(movie_url, hour, minute, second, am_pm, how): when each recording began: by the clock of its blue screen, else by the first change
    of its taskbar's minute (hour and am_pm null); recordings with neither have no row.

    screens: movie_url, ord, text, of the first frames that are blue screens. bars: movie_url, place, ord, text, of the
    taskbars; place is the second from the recording's start. Null texts show nothing.
    """
    blue = blue_screen_time(screens).select("movie_url", *[F.col(c).cast("int").alias(c) for c in ("hour", "minute", "second")], "am_pm", F.lit("blue_screen").alias("how"))
    bar = roll_over(bar_minutes(bars)).join(blue.select("movie_url"), "movie_url", "left_anti")
    return blue.unionByName(bar.select("movie_url", F.lit(None).cast("int").alias("hour"), "minute", "second", F.lit(None).cast("string").alias("am_pm"), F.lit("taskbar").alias("how")))
