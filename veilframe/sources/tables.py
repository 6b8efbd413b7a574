"""Tables in a folder, and the shapes that the queries see in them: matches, frames, jobs, OCR lines, telemetry.

A match is a rectangle in a frameset (frames that share a perceptual hash) of a movie, found by a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return lines.join(parts, "l_partkey").selectExpr(
        "concat('job_', l_linenumber % 3) job_id", "concat('m', l_orderkey % 10) movie_url", "l_orderkey frameset", "l_partkey - l_suppkey % 3 match_id",
        "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber uid",
        "cast((l_partkey * 37) % 1800 as int) x", "cast((l_suppkey * 53 + l_linenumber * 101) % 1000 as int) y", "cast(10 + floor(l_quantity) as int) w", "8 + 2 * l_linenumber h",
        "l_returnflag scanner_type", "p_name text", "p_brand app_id",
    )


MATCHES_SQL = """m as (select 'job_' || (l_linenumber % 3) job_id, 'm' || (l_orderkey % 10) movie_url, l_orderkey frameset, l_partkey - l_suppkey % 3 match_id,
  l_partkey * 1000000 + l_suppkey * 10 + l_linenumber uid, ((l_partkey * 37) % 1800)::int x, ((l_suppkey * 53 + l_linenumber * 101) % 1000)::int y,
  (10 + floor(l_quantity))::int w, 8 + 2 * l_linenumber h, l_returnflag scanner_type, p_name "text", p_brand app_id
  from lineitem join part on l_partkey = p_partkey)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movie, time, hash and image of each frame (ts is unique within a movie)."""
    return table(spark, sf_dir, "events").selectExpr("concat('m', user_id % 50) movie_url", "ts", "event_type frameset", "concat('frame_', event_id, '.png') image", "value", "event_id")


FRAMES_SQL = "f as (select 'm' || (user_id % 50) movie_url, ts, event_type frameset, 'frame_' || event_id || '.png' image, value, event_id from events)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of jobs: a job's parent has a seventh of its number; roots have none."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey id", "case when o_orderkey div 7 > 0 then o_orderkey div 7 end parent_id",
        "case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'failed' end status", "o_orderdate created_on", "o_custkey % 20 owner",
    )


JOBS_SQL = "j as (select o_orderkey id, case when o_orderkey // 7 > 0 then o_orderkey // 7 end parent_id, case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'failed' end status, o_orderdate created_on, o_custkey % 20 owner from orders)"


def result_of(results: DataFrame, job_id: str) -> DataFrame:
    """What another job has found: results are kept in folders by job_id, so that no other job's are read."""
    return results.where(F.col("job_id") == job_id)


def write_results(results: DataFrame, path: str) -> None:
    """Results as a table with a folder for each job; jobs that come again replace their own folder alone."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def listing(files: DataFrame, folder: str, size: str) -> DataFrame:
    """Bytes and number of files of each folder, and of all ('all'; files without a folder are counted there as well)."""
    sums = files.groupingSets([[folder], []], folder).agg(F.sum(size).alias("n_bytes"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sums.where(F.col(folder).isNotNull() | (F.col("g") > 0)).select(F.coalesce(folder, F.lit("all")).alias(folder), "n_bytes", "n")
