"""Scores of what was found against what should have been: frame, movie, job.

Null counts, and frames of no pixels, give null scores, which means leave out and which fail nothing. Without movies the
job's score is null. Ties are told at each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECTIVE = {
    "weight_false_pos": 1.0, "weight_false_neg": 20.0, "frame_passing_score": 70.0, "movie_passing_score": 70.0, "max_num_failed_frames": 2,
    "max_num_missed_entities_single_frameset": 1_000_000, "hard_fail_from_any_frame": False,
}


def frame_scores(counts: DataFrame, objective: dict | None = None) -> DataFrame:
    """counts: movie_url, frameset, total, f_pos, f_neg (pixels), and missed (items), if that is counted. Adds score (2 digits, half to even, not
    below 0) and failed: the score is too low, or more items are missed than the objective allows (null: none)."""
    o = OBJECTIVE | (objective or {})
    raw = f"greatest(0.0D, 100.0D - 100.0D * {o['weight_false_pos']}D * f_pos / nullif(total, 0) - 100.0D * {o['weight_false_neg']}D * f_neg / nullif(total, 0))"
    known = "f_pos is not null and f_neg is not null and total <> 0"
    failed = F.col("score") < o["frame_passing_score"]
    if "missed" in counts.columns:
        failed = failed | (F.coalesce("missed", F.lit(0)) > o["max_num_missed_entities_single_frameset"])
    return counts.withColumn("score", F.expr(f"case when {known} then bround({raw}, 2) end")).withColumn("failed", failed)


def movie_scores(frames: DataFrame, objective: dict | None = None) -> DataFrame:
    """Mean of a movie's rounded frame scores; failed if too low or too many frames failed, or, by hard_fail_from_any_frame, if one did."""
    by = frames.groupBy("movie_url").agg(
        F.bround(F.avg(F.col("score").cast("decimal(12,2)")).cast("double"), 2).alias("score"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.count_if("failed").alias("n_failed"), F.count("*").alias("n_frames")
    )
    o = OBJECTIVE | (objective or {})
    most = 1 if o["hard_fail_from_any_frame"] else o["max_num_failed_frames"]
    return by.withColumn("failed", F.expr(f"n_failed >= {most} and n_failed > 0 or score < {o['movie_passing_score']}"))


def job_score(movies: DataFrame) -> DataFrame:
    """Mean of the rounded movie scores; failed if any movie failed."""
    return movies.agg(F.bround(F.avg(F.col("score").cast("decimal(12,2)")).cast("double"), 2).alias("score"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.max("failed").alias("failed"))


def series(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, series): each group's values in order, as a chart shows them. Null values stay out."""
    by = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("s"))
    return by.select(*keys, F.expr("transform(s, e -> e.__v)").alias("series"))


def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): each group's most frequent value and how often it occurs; of equally frequent ones the largest."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max(F.struct("n", F.col(value).alias("value"))).alias("m")).select(*keys, "m.value", "m.n")


def by_interest(cells: DataFrame) -> DataFrame:
    """place: a mesh cell's number in its frameset, the most interesting first; ties by uid."""
    from pyspark.sql.window import Window

    return cells.withColumn("place", F.row_number().over(Window.partitionBy("movie_url", "frameset").orderBy(F.col("interest").desc_nulls_last(), "uid")))
