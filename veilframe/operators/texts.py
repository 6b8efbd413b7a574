"""Recognised text: phrase matching, regular expressions, logs.

Null texts match no pattern and no phrase; patterns are Java's. Repeated rows stay repeated where rows are filtered. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import indel_ratio, match_masks, ratio_bound

def _letters(texts: DataFrame, name: str, threshold: int) -> DataFrame:
    """The rows for each of the letters that a text similar to this one must share with it at the latest (__letter), with all its letters (__name).

    Letters are told apart by how many of their kind stand before them, so that texts share as many as their bags do. All
    texts have them in one order, seldom ones (the third of its kind) first.
    """
    n, s = f"length({name})", 2 * threshold + 1  # rounded, a ratio above the threshold is at least s / 2
    chars = f"array_distinct(transform(sequence(1, {n}), i -> substring({name}, i, 1)))"
    each = f"flatten(transform({chars}, c -> transform(sequence(1, {n} - length(replace({name}, c, ''))), k -> struct(-k as k, c))))"
    shortest = f"(({s} * {n} + {399 - s}) div {400 - s})"
    shared = f"(({s} * ({n} + {shortest}) + 399) div 400)"
    bags = texts.where(f"{n} > 0").withColumn(f"__{name}", F.expr(f"transform(array_sort({each}), x -> concat(x.c, -x.k))"))
    return bags.withColumn("__letter", F.explode(F.expr(f"slice(__{name}, 1, cast(greatest(0, {n} - {shared} + 1) as int))")))


def similar(texts: DataFrame, phrases: DataFrame, threshold: int = 70) -> DataFrame:
    """Distinct texts (text) with all phrases (phrase, other columns stay) that are more similar than the threshold (0-100), and the ratio.

    A prefix join over letters: texts above the threshold share so many letters that one of the first few is among them,
    and no pair is missed. A pair is met at its first shared letter alone, and compared in full only if the shared letters would
    be enough in the same order. Which side is small enough to be broadcast is seen when the query runs. Null and empty texts
    are similar to nothing here; repeated phrases stay repeated.
    """
    if not 0 <= threshold <= 100:
        raise ValueError("the threshold is a ratio of 0 to 100")
    t = _letters(texts.select("text").where("text is not null").distinct().withColumn("__masks", F.expr(match_masks("text"))), "text", threshold)
    pairs = t.join(_letters(phrases, "phrase", threshold), "__letter").where(ratio_bound("text", "phrase") > threshold)
    pairs = pairs.withColumn("__shared", F.array_intersect("__text", "__phrase"))
    pairs = pairs.where(F.expr(f"__shared[0] = __letter and 400 * size(__shared) >= {2 * threshold + 1} * (length(text) + length(phrase))"))
    pairs = pairs.withColumn("ratio", indel_ratio("text", "phrase", "__masks")).where(F.col("ratio") > threshold)
    return pairs.select("text", *phrases.columns, "ratio")


def fuzzy_phrases(texts: DataFrame, phrases: DataFrame, threshold: int = 70) -> DataFrame:
    """Each distinct text with the first phrase (by ord) that is more similar than the threshold."""
    scored = similar(texts, phrases.select("ord", "phrase"), threshold)
    return scored.groupBy("text").agg(F.min_by(F.struct("phrase", "ratio"), "ord").alias("hit")).select("text", "hit.phrase", "hit.ratio")


def regex_hits(texts: DataFrame, pattern: str) -> DataFrame:
    """Texts that the pattern finds, with its first group (the whole text if it has none or the group is empty)."""
    return texts.where(F.col("text").rlike(pattern)).withColumn("hit", F.coalesce(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")), F.col("text")))


def seconds_into_log(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that match, with the seconds (less whole days) since the log's earliest time stamp."""
    t = lines.withColumn("at", F.try_to_timestamp(F.regexp_extract("line", r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss"))).where("at is not null")
    first = t.groupBy("log_id").agg(F.min("at").alias("first"))
    return t.where(F.col("line").rlike(pattern)).join(first, "log_id").withColumn("second", F.expr("(unix_timestamp(at) - unix_timestamp(first)) % 86400")).drop("first")


def frames_of_log(lines: DataFrame, pattern: str, offset: int) -> DataFrame:
    """seconds_into_log() less what the recording began after the log; lines from before it are left out."""
    return seconds_into_log(lines, pattern).withColumn("second", F.col("second") - offset).where("second >= 0")


def mappings(lines: DataFrame) -> DataFrame:
    """Lines (text) of two forms, "recording: transaction" and "('recording', 'transaction')", with both names; others are left out."""
    pair = r"\(\s*'([^']*)'\s*,\s*'([^']*)'"
    quoted = F.col("text").rlike(pair)
    plain = ~quoted & F.col("text").contains(":")
    one = lambda i: F.when(quoted, F.regexp_extract("text", pair, i)).otherwise(F.trim(F.regexp_extract("text", r"^([^:]*):([\s\S]*)$", i)))
    return lines.where(quoted | plain).withColumn("recording", one(1)).withColumn("transaction", one(2))


def csv_ready(rows: DataFrame) -> DataFrame:
    """Nested columns (structs, maps, arrays) written as JSON, so that every column is a plain value."""
    nested = [f.name for f in rows.schema if f.dataType.typeName() in ("struct", "map", "array")]
    return rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])


def phrases_of(matches: DataFrame, values: list[str], order: list[str]) -> DataFrame:
    """(movie_url, text, values) of the distinct texts that a movie's items have, with what the first one says (app id, made-up text)."""
    by = matches.where("text is not null").groupBy("movie_url", "text").agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v"))
    return by.select("movie_url", "text", "v.*")
