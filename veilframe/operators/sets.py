"""Set operations over matches: what jobs found, added, taken away and intersected.

Framesets or ids that are null match nothing: such rows stay in differences and drop out of intersections and of what has
to be in every job. Repeated rows stay as often as they are. Other columns pass through; helper columns begin with two
underscores. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = ("movie_url", "frameset")


def bag_sum(matches: DataFrame) -> DataFrame:
    """All jobs' matches; of matches of a frameset that share an id, all but the first get a key of their own."""
    order = Window.partitionBy(*FRAME, "match_id").orderBy("job_id", "uid")
    return matches.withColumn("match_key", F.when(F.row_number().over(order) == 1, F.col("match_id").cast("string")).otherwise(F.concat(F.lit("sum_key_"), F.col("uid").cast("string"))))


def mandatory(matches: DataFrame, job_ids: list[str]) -> DataFrame:
    """Matches of the mandatory jobs, and those of others in framesets that every mandatory job has."""
    must = F.col("job_id").isin(job_ids)
    everywhere = matches.where(must).groupBy(*FRAME).agg(F.count_distinct("job_id").alias("n")).where(F.col("n") == len(job_ids)).select(*FRAME)
    return matches.where(must).unionByName(matches.where(~must).join(everywhere, list(FRAME), "left_semi"))


def difference(minuend: DataFrame, subtrahend: DataFrame, *, by_match: bool = True) -> DataFrame:
    """The minuend's matches (or, not by_match, framesets) that the subtrahend doesn't have."""
    keys = [*FRAME, "match_id"] if by_match else list(FRAME)
    return minuend.join(subtrahend.select(*keys).distinct(), keys, "left_anti")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlaps of the rectangles of two jobs, frameset by frameset (edges count as inside)."""
    r = right.select(*FRAME, F.col("uid").alias("other"), *[F.col(c).alias(f"r_{c}") for c in "xywh"])
    both = left.join(r, list(FRAME)).where("x <= r_x + r_w and r_x <= x + w and y <= r_y + r_h and r_y <= y + h")
    return both.selectExpr(*FRAME, "uid", "other", "greatest(x, r_x) x", "greatest(y, r_y) y", "least(x + w, r_x + r_w) - greatest(x, r_x) w", "least(y + h, r_y + r_h) - greatest(y, r_y) h")


def any_criterion(matches: DataFrame, criteria: dict[str, list]) -> DataFrame:
    """Matches that meet at least one criterion: attribute -> accepted values."""
    test = F.lit(False)
    for name, values in criteria.items():
        test = test | F.coalesce(F.col(name).isin(values), F.lit(False))
    return matches.where(test)


def containing(rows: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows with each needle that their text contains. Null and empty texts and needles match nothing.

    An equi-join, not all pairs: texts are cut into their pieces of just the lengths that needles have.
    """
    n = needles.where(F.length(needle) > 0)
    lengths = sorted(r[0] for r in n.select(F.length(needle)).distinct().collect())
    if not lengths:
        return rows.join(n.limit(0), F.lit(False))
    texts, found = rows.select(F.col(text)).distinct(), None
    for k in lengths:
        cut = f"array_distinct(transform(sequence(1, length({text}) - {k} + 1), i -> substring({text}, i, {k})))"
        pieces = texts.where(F.length(text) >= k).select(text, F.explode(F.expr(cut)).alias("__piece"))
        found = pieces if found is None else found.unionByName(pieces)
    return rows.join(found.join(n, F.col("__piece") == F.col(needle)).drop("__piece"), text)


def unmatched(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the others don't have; null keys are never had."""
    return rows.join(others.select(*keys).distinct(), keys, "left_anti")


def fan_in(matches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What children found, put together: of rows that share keys the last child's counts."""
    rest = [c for c in matches.columns if c not in keys]
    return matches.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*keys, "m.*")


def replaced(matches: DataFrame, keys: list[str], child: str) -> DataFrame:
    """What children found, where a later child replaces all that earlier ones have of a movie or frameset (keys)."""
    last = matches.groupBy(*keys).agg(F.max(child).alias(child))
    return matches.join(last, [*keys, child], "left_semi")


def carried_in(inputs: DataFrame, ocr: DataFrame) -> DataFrame:
    """A scanner's input with the recognised text of its framesets added; framesets it doesn't have stay out."""
    return inputs.unionByName(ocr.join(inputs.select(*FRAME).distinct(), list(FRAME), "left_semi").select(*inputs.columns))


def all_anchors(matches: DataFrame, anchors: list[str]) -> DataFrame:
    """Matches of the framesets where every anchor (anchor_id) was found."""
    full = matches.where(F.col("anchor_id").isin(anchors)).groupBy(*FRAME).agg(F.count_distinct("anchor_id").alias("n")).where(F.col("n") == len(set(anchors)))
    return matches.join(full.select(*FRAME), list(FRAME), "left_semi")


def with_first(matches: DataFrame, others: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Matches with p, a struct of the values of another job's first match in their frameset; null if it has none."""
    first = others.groupBy(*FRAME).agg(F.min_by(F.struct(*values), order).alias("p"))
    return matches.join(first, list(FRAME), "left")


def of_app(matches: DataFrame, app: str) -> DataFrame:
    """Matches that name this app or none."""
    return matches.where(F.col("app_id").isNull() | (F.col("app_id") == app))
