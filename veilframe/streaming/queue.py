"""The queue of recordings to work on, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANNOTATION = "accountId string, timestamp string, value string, agentId string"
TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]'Z'"


def parse_items(items: DataFrame, pipelines: list[str]) -> DataFrame:
    """Items (Annotation JSON, Pipeline): account, ts, recording and pipeline of the valid ones; others are dropped."""
    a = F.from_json("Annotation", ANNOTATION)
    rows = items.select(a.alias("a"), F.col("Pipeline").alias("pipeline"))
    rows = rows.select(F.expr("try_cast(a.accountId as long)").alias("account"), F.try_to_timestamp(F.col("a.timestamp"), F.lit(TIME)).alias("ts"), F.col("a.value").alias("recording"), "pipeline")
    return rows.where("account is not null and ts is not null and recording is not null").where(F.col("pipeline").isin(pipelines))


def first_arrivals(items: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Each recording once, however often it is sent again within the time."""
    return items.withWatermark("ts", within).dropDuplicatesWithinWatermark(["recording"])


def admitted(batch: DataFrame, running: int, throttle: int = 25) -> DataFrame:
    """The oldest items of a table for which there is room. The others stay where they are: a stream's batch is gone once it is
    committed, so a running queue takes streaming.admission.admissions(), which keeps them."""
    return batch.orderBy("ts", "recording").limit(max(0, throttle - running))


def to_retry(dispatched: DataFrame, now: str, wait: str = "2 hours", most: int = 1) -> DataFrame:
    """The one recording to send again in this pass: of (recording, ts, status, retries) the longest-waiting unfinished one.

    It must have waited for longer than `wait` and been retried fewer than `most` times (null counts as 0); ties go by
    recording. Null times never are stale.
    """
    late = F.col("ts") < F.lit(now).cast("timestamp") - F.expr(f"interval {wait}")
    return dispatched.where(late & ~F.coalesce("status", F.lit("")).isin("success", "failed") & (F.coalesce("retries", F.lit(0)) < most)).orderBy("ts", "recording").limit(1)


def unreceived(dispatched: DataFrame, received: DataFrame) -> DataFrame:
    """Recordings that were sent out and have not come in; null recordings never come in."""
    return dispatched.join(received.select("recording").where("recording is not null").distinct(), "recording", "left_anti")


def has_room(jobs: DataFrame, unreceived: int, throttle: int = 25) -> bool:
    """Whether another recording may be sent out: running jobs and those not yet received stay below the throttle."""
    return jobs.where("status = 'running'").count() + unreceived < throttle
