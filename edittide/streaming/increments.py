"""Statistics over streams of elements.

Daily windows run as a streaming aggregation. Distinct counts, which a stream cannot keep, and merges with
earlier results run per micro-batch: additive counters per user are merged into a versioned Parquet snapshot, of which
the newest complete version is the state, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edittide.functions import columns as C
from edittide.operators import incremental, stats


def day_counts(elements: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, action, n) in windows of one UTC day; elements later than `late` behind the newest are dropped in a stream."""
    if isinstance(elements.schema["ts"].dataType, T.TimestampNTZType):  # a watermark needs instants
        elements = elements.withColumn("ts", C.instant(F.col("ts")))
    e = stats.prepared(elements.withWatermark("ts", late))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "action").agg(F.count("*").alias("n")).select(C.day(F.col("w.start")).alias("day"), "action", "n")


def snapshot(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    return None if version < 0 else spark.read.parquet(f"{path}/version={version}")


def into_snapshot(path: str, summarise: Callable[[DataFrame], DataFrame], key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch's statistics into the snapshot of the batch before and writes the next version."""

    def write(batch: DataFrame, number: int) -> None:
        new = summarise(batch)
        old = snapshot(batch.sparkSession, path, number - 1)
        merged = new if old is None else incremental.merge(old, new, key).select(*new.columns)
        merged.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write
