"""Scanners, pipelines and movies as archives and catalogs hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.shared import stored

#: What is read of a scanner's content, of whatever type.
CONTENT = "anchors array<string>, mask_zones array<string>, areas array<string>, match_text array<string>, match_percent int, scale string, scan_level string, match_method string, select_type string"


def scanner_metadata(scanners: DataFrame) -> DataFrame:
    """Scanners (type, content as JSON, other columns) with what lists show of them: sizes of arrays, texts joined by commas.

    What a type doesn't have is null; content that is no JSON gives nulls.
    """
    c = scanners.withColumn("c", F.from_json("content", CONTENT))
    only = lambda kind, e: F.when(F.col("type") == kind, F.expr(e))
    size = lambda e: f"case when {e} is not null then size({e}) end"
    return c.select(
        *[x for x in scanners.columns if x != "content"], F.length("content").alias("content_length"), only("template", size("c.anchors")).alias("num_anchors"), only("template", size("c.mask_zones")).alias("num_mask_zones"),
        only("selected_area_meta", size("c.areas")).alias("num_areas"), only("ocr", "array_join(c.match_text, ',')").alias("match_text"), F.col("c.match_percent").alias("match_percent"), "c.scale", "c.scan_level", "c.match_method", "c.select_type",
    )


def scanners_with(scanners: DataFrame, attributes: DataFrame, test: str, name: str, value: str) -> DataFrame:
    """Scanners (id) that pass the test and have an attribute (id, name, value) of exactly this name and value."""
    have = attributes.where((F.col("name") == name) & (F.col("value") == value)).select("id").distinct()
    return scanners.where(test).join(have, "id", "left_semi")


def rebased(rows: DataFrame, url: str, moves: DataFrame, limit: int = 100_000) -> DataFrame:
    """URLs whose folder (the last but one part) has moved (old, new) point to the new one; others stay. Null folders never move.

    Moves are counted and broadcast if they are few; of moves of one folder the smallest new name counts.
    """
    m = moves.where("old is not null").groupBy(F.col("old").alias("__old")).agg(F.min("new").alias("__new"))
    m = F.broadcast(m) if m.count() <= limit else m
    parts = rows.withColumn("__old", F.regexp_extract(url, "([^/]*)/[^/]*$", 1))
    head, tail = F.regexp_extract(url, "^(.*/)?[^/]*/[^/]*$", 1), F.regexp_extract(url, "(/[^/]*)$", 1)
    return parts.join(m, "__old", "left").withColumn(url, F.when(F.col("__new").isNull(), F.col(url)).otherwise(F.concat(head, "__new", tail))).drop("__old", "__new")


def write_metadata(df: DataFrame, path: str) -> None:
    """Movie metadata as lines of JSON, one file for each part; nulls are left out."""
    df.write.mode("overwrite").json(path)


def read_metadata(spark, path: str, schema) -> DataFrame:
    """Metadata read back with a given schema; broken lines give nulls."""
    return spark.read.schema(schema).json(path)


def metadata_round_trip(df: DataFrame) -> DataFrame:
    """df, written as metadata to the shared folder and read back."""
    lines = stored(df.select(F.to_json(F.struct(*df.columns)).alias("line")))
    return lines.select(F.from_json("line", df.schema).alias("x")).select("x.*")


def with_attributes(pipelines: DataFrame, attributes: DataFrame, links: DataFrame) -> DataFrame:
    """Pipelines with a map of their attributes (largest value of a name) and the sorted ids of their jobs; none: empty."""
    one = attributes.where("name is not null").groupBy("pipeline", "name").agg(F.max("value").alias("value"))
    maps = one.groupBy("pipeline").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    jobs = links.where("job_id is not null").groupBy("pipeline").agg(F.array_sort(F.collect_set("job_id")).alias("job_ids"))
    rows = pipelines.join(maps, "pipeline", "left").join(jobs, "pipeline", "left")
    return rows.select("pipeline", F.coalesce("attributes", F.expr("cast(map() as map<string,string>)")).alias("attributes"), F.coalesce("job_ids", F.expr("cast(array() as array<bigint>)")).alias("job_ids"))
