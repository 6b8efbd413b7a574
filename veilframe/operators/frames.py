"""Frames and framesets: grouping by hash, order, what came before, ranges of time.

Frames are ordered by ts and then event_id (null times first; frames equal in both in any order). A null hash is a frameset like
others where frames are grouped, and equals nothing where they are compared or joined. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(frames: DataFrame) -> DataFrame:
    """frame_seq: a frame's place in its movie, from 0."""
    return frames.withColumn("frame_seq", F.row_number().over(Window.partitionBy("movie_url").orderBy("ts", "event_id")) - 1)


def framesets(frames: DataFrame) -> DataFrame:
    """Frames of a movie that share a hash: how many, the first one's image and time."""
    return frames.groupBy("movie_url", "frameset").agg(F.count("*").alias("n_frames"), F.min("ts").alias("first_ts"), F.min_by("image", F.struct("ts", "event_id")).alias("image"))


def frameset_order(frames: DataFrame) -> DataFrame:
    """Framesets in the order of their first frames."""
    sets = framesets(frames)
    return sets.withColumn("place", F.row_number().over(Window.partitionBy("movie_url").orderBy("first_ts", "frameset")))


def truncate_at(frames: DataFrame, frameset: str) -> DataFrame:
    """Framesets that begin before the given one does, in each movie that has it; other movies whole."""
    order = frameset_order(frames)
    stop = order.where(F.col("frameset") == frameset).select("movie_url", F.col("place").alias("stop"))
    return order.join(stop, "movie_url", "left").where("stop is null or place < stop").drop("stop")


def carried(frames: DataFrame, found: str) -> DataFrame:
    """last_found: the image of the last frame up to this one where `found` holds."""
    upto = Window.partitionBy("movie_url").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn("last_found", F.last(F.when(F.expr(found), F.col("image")), ignorenulls=True).over(upto))


def changes(frames: DataFrame) -> DataFrame:
    """Frames whose hash differs from the one before; the first of each movie too."""
    before = F.lag("frameset").over(Window.partitionBy("movie_url").orderBy("ts", "event_id"))
    return frames.withColumn("before", before).where("before is null or before <> frameset")


def batches(frames: DataFrame, size: int) -> DataFrame:
    return numbered(frames).withColumn("batch", F.expr(f"frame_seq div {size}"))


#: Seconds that ranges are cut into pieces of.
PIECE = 256


def black_out(frames: DataFrame, ranges: DataFrame, black: str) -> DataFrame:
    """Frames outside of all ranges (lo, hi: first and last second, both included) show the black image.

    Ranges are cut into pieces of PIECE seconds, as far as some movie goes, and what is left of them in each piece is put together for an
    equi-join: at most one row a piece, of at most PIECE * PIECE / 2 different parts. Those with a null end or hi < lo are left out.
    """
    f = numbered(frames).withColumn("frame_seq", F.col("frame_seq").cast("long"))
    most = frames.groupBy("movie_url").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    lit = ranges.where(F.col("lo") <= F.col("hi")).select(F.greatest("lo", F.lit(0)).cast("long").alias("a"), F.least("hi", most).cast("long").alias("b")).where("a <= b")
    cut = lit.select("a", "b", F.explode(F.expr(f"sequence(a div {PIECE}, b div {PIECE})")).alias("__piece"))
    parts = cut.select("__piece", F.expr(f"named_struct('a', greatest(a - __piece * {PIECE}, 0L), 'b', least(b - __piece * {PIECE}, {PIECE - 1}L))").alias("p"))
    parts = parts.groupBy("__piece").agg(F.collect_set("p").alias("__parts"))
    shown = F.expr(f"exists(__parts, p -> frame_seq % {PIECE} between p.a and p.b)")
    d = f.withColumn("__piece", F.expr(f"frame_seq div {PIECE}")).join(parts, "__piece", "left")
    return d.withColumn("image", F.when(shown, F.col("image")).otherwise(F.lit(black))).drop("__piece", "__parts")


def final_image(frames: DataFrame, redacted: DataFrame, illustrated: DataFrame) -> DataFrame:
    """What each frame shows at last: its frameset's illustration, else its redaction, else itself.

    A frame without a frameset (null) shows what its movie's first frameset does: the one of the earliest frame.
    """
    keys = ["movie_url", "frameset"]
    own = frames.withColumn("__own", F.col("frameset"))
    first = frames.where("frameset is not null").groupBy("movie_url").agg(F.min_by(F.struct("frameset", "image"), F.struct("ts", "event_id")).alias("__f"))
    lost = own.where("frameset is null").join(first, "movie_url", "left").withColumn("frameset", F.col("__f.frameset")).withColumn("__image", F.coalesce("__f.image", "image")).drop("__f")
    rows = own.where("frameset is not null").withColumn("__image", F.col("image")).unionByName(lost)
    both = rows.join(redacted, keys, "left").join(illustrated, keys, "left").withColumn("final", F.coalesce("illustrated_image", "redacted_image", "__image"))
    return both.withColumn("frameset", F.col("__own")).drop("__own", "__image")


def skip_first(frames: DataFrame, n: int) -> DataFrame:
    """Framesets in order, but for each movie's first n."""
    return frameset_order(frames).where(F.col("place") > n)


def images_in_order(frames: DataFrame) -> DataFrame:
    """Framesets with all their images in the order of the frames."""
    by = frames.groupBy("movie_url", "frameset").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "image"))).alias("f"))
    return by.select("movie_url", "frameset", F.expr("transform(f, x -> x.image)").alias("images"))


def matches_before(matches: DataFrame, frames: DataFrame, frameset: str) -> DataFrame:
    """Matches of the framesets that stay when movies are cut at a frameset; those of framesets without frames go."""
    return matches.join(truncate_at(frames, frameset).select("movie_url", "frameset"), ["movie_url", "frameset"], "left_semi")


def gathered(frames: DataFrame) -> DataFrame:
    """Framesets with the URLs of their images, sorted as text."""
    return frames.groupBy("movie_url", "frameset").agg(F.array_sort(F.collect_list("image")).alias("images"))


def hashed_batches(frames: DataFrame, size: int) -> DataFrame:
    """Frames grouped by hash within each batch of a movie's frames."""
    return batches(frames, size).groupBy("movie_url", "batch", "frameset").agg(F.count("*").alias("n_frames"), F.min("ts").alias("first_ts"))


def merged_batches(parts: DataFrame) -> DataFrame:
    """What batches have grouped by hash, put together."""
    return parts.groupBy("movie_url", "frameset").agg(F.sum("n_frames").alias("n_frames"), F.min("first_ts").alias("first_ts"))


def merge_framesets(frames: DataFrame, into: str, merged: str) -> DataFrame:
    """Frames of one frameset become frames of another."""
    return frames.withColumn("frameset", F.when(F.col("frameset") == merged, F.lit(into)).otherwise(F.col("frameset")))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Frames or matches but for those of framesets that are removed."""
    return rows.join(gone.select("movie_url", "frameset").distinct(), ["movie_url", "frameset"], "left_anti")


def cleared(frames: DataFrame, *columns: str) -> DataFrame:
    """The columns (redactions, illustrations) emptied in all rows."""
    for c in columns:
        frames = frames.withColumn(c, F.lit(None).cast(frames.schema[c].dataType))
    return frames
