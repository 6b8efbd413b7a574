"""Tables between rounds: written to the folder that the cluster shares and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str = "rounds") -> str:
    """A new folder's name under spark.checkpoint.dir; only where that is unset, under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to a new_folder() and read it back: cuts the lineage of iterative operators and survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
