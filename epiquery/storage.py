"""Session defaults, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One broadcast side may be this large; every explicit broadcast in the package is guarded by it.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for operators that spend much time on each row.

    A no-op (no shuffle) wherever the input has enough splits, which any large table has; one small file has a single one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def bounded_sample(df: DataFrame, key: Column, rows: int, spare: int = 4) -> DataFrame:
    """df with `__k`, the hash of a key, cut to the first `rows` rows by that hash.

    Filter first, so that only rows that may be drawn count. Only hashes of about spare x rows rows are ranked, so what follows reads no more
    rows than are drawn, at any size of the table."""
    n = df.count()
    d = df.withColumn("__k", F.xxhash64(key))
    part = d.where(F.col("__k") < F.lit(-(1 << 63) + (1 << 64) * spare * rows // n)) if n > spare * rows else d
    last = part.select("__k").orderBy("__k").limit(rows).agg(F.max("__k")).first()[0]
    return part.where(F.lit(False) if last is None else F.col("__k") <= last)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. Without one only a local master will do (tests), which gets a folder that is deleted at its end."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(own := tempfile.mkdtemp(prefix="epiquery-"))
            atexit.register(shutil.rmtree, own, True)
        else:
            sc.setCheckpointDir(configured)
    if configured:
        return configured
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Durable intermediate tables of one query, in the shared folder. Old ones can be dropped as soon as newer ones replace them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
        self.n = 0
        atexit.register(self.clear)

    def clear(self) -> None:
        """Deletes the tables; by default at the end of the driver, since results are read from them lazily."""
        with contextlib.suppress(Exception):
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def save(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back: cuts lineage and survives the loss of executors. A saved table stays as it is."""
        if getattr(df, "_scratch_path", None):
            return df
        path = f"{self.root}/{self.n}"
        self.n += 1
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Frees the shuffle files of finished jobs now, and not when the driver happens to collect its garbage: called after a save whose
        shuffle was large and before the next large one, which then doesn't come on top of it."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * bytes_per_row <= limit
