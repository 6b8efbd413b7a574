"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares (spark.checkpoint.dir).

    Only where that setting is absent (tests on one machine) a folder under the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/veilframe-{uuid.uuid4().hex}"


def stored(df: DataFrame, *, release: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    release: the shuffles behind it are large. Spark deletes a shuffle's files when the driver collects its handle as
    garbage; that is asked for at once, so that the disks are free for what comes next.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of the undirected edges (a, b): columns node, component.

    Labels take the minimum over neighbours, then jump to their label's label, so that the rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder; nothing goes to the driver but a count.
    Null ends are left out; an edge from a node to itself gives that node; repeated edges change nothing.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    both = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = lower.select(F.col("node").alias("mid"), F.col("mid").alias("next"))
        new = lower.join(jump, "mid", "left").select("node", "old", F.coalesce("next", "mid").alias("component"))
        new = stored(new)
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def slices(texts: list, most: int):
    """(from, to) of runs of texts of about `most` bytes together, so that arrays made of them stay small."""
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most or i == len(texts) - 1:
            yield a, i + 1
            a, held = i + 1, 0


def parts(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Cut a batch into runs of rows whose values in a column have about `most` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    a = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most or i == len(sizes) - 1:
            yield batch.slice(a, i + 1 - a)
            a, held = i + 1, 0


def map_text(df: DataFrame, text: str, added: str, start, keep: list[str] | None = None, kind: str = "string") -> DataFrame:
    """Add columns that a Python function makes from whole texts, about 2 MB of them at a time.

    added: their DDL. start() runs once in each task and returns the function from a list of texts (str or None) to
    the arrays of the added columns. keep: columns of df that stay (all). Columns of df named like the added ones go.
    """
    kinds = T._parse_datatype_string(added)
    d = df.select(*[c for c in (df.columns if keep is None else keep) if c not in kinds.names], F.col(text).cast(kind).alias("__text"))
    schema = T.StructType([f for f in d.schema if f.name != "__text"] + kinds.fields)
    arrow = to_arrow_schema(kinds)

    def run(batches):
        fn = start()
        for b in (part for batch in batches for part in parts(batch, "__text")):
            new = [pa.array(x, f.type) for x, f in zip(fn(b.column("__text").to_pylist()), arrow, strict=True)]
            old = [b.column(i) for i, n in enumerate(b.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays(old + new, names=schema.names)

    return d.mapInArrow(run, schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte of equal weight, compressed."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) for a in arrays)
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays), 1)


def unpack(body: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(body)
    out, at = [], 1 + 5 * data[0]
    for i in range(data[0]):
        kind, n = struct.unpack_from("<cI", data, 1 + 5 * i)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind)[:, 0])
        at += n * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 2**32 else np.uint64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def ranks(*keys: np.ndarray) -> np.ndarray:
    """The number of each row's run of equal keys."""
    out = np.zeros(len(keys[0]), np.int64)
    out[runs(*keys)[1:]] = 1
    return np.cumsum(out)
