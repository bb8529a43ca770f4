"""What the operators share: cutting lineage, reading tables, free column names and sums in order."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one on a local master; else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later steps read them and survive lost executors.

    What led to them is let go of at once, so that Spark's cleaner removes shuffle files of earlier steps, which would
    otherwise stay on the executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def free(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores before it until no column of `taken` has it in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def in_order(df: DataFrame, order: Sequence[Column], sums: dict[str, Column | str]) -> DataFrame:
    """`df` with a column for each of `sums`: the sum of a numeric column over all earlier rows in `order`, which must be total.

    No task sees all rows: they are range-sorted and written once, summed by partition, and the sums of earlier partitions, one small
    row each, are added to those inside a partition.
    """
    part, own = free("_part", df.columns), [free(f"_s{i}", df.columns) for i in range(len(sums))]
    spread = cut(df.withColumns({o: F.expr(c) if isinstance(c, str) else c for o, c in zip(own, sums.values())}).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    summed = spread.groupBy(part).agg(*[F.sum(o).alias(o) for o in own])
    kinds = {o: summed.schema[o].dataType.simpleString() for o in own}
    before, at = [], [0.0 if kinds[o] == "double" else 0 for o in own]
    for r in sorted(summed.collect()):
        before.append((r[part], *at))
        at = [a + (r[o] or 0) for a, o in zip(at, own)]
    offsets = df.sparkSession.createDataFrame(before, f"{part} int, " + ", ".join(f"{o}_b {kinds[o]}" for o in own))
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumns({n: F.coalesce(F.sum(o).over(w), F.lit(0)) for n, o in zip(sums, own)})
    out = inside.join(F.broadcast(offsets), part)  # a row for each partition
    return out.select(*df.columns, *[(F.col(n) + F.col(f"{o}_b")).alias(n) for n, o in zip(sums, own)])
