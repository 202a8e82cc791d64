"""Sinks: versioned artifacts and drop-and-reload collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexicon as L


def save_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_collections(keywords: DataFrame, path: str) -> None:
    """Keywords by annotation type, one partition a collection, replacing what was there; a keyword that repeats within a
    collection raises."""
    k = keywords.withColumn("collection", L.keyword_type(F.col("category"))).where("collection is not null")
    twice = k.groupBy("collection", "keyword").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"keyword {twice[0].keyword!r} repeats in {twice[0].collection}")
    k.write.mode("overwrite").partitionBy("collection").parquet(path)


def save_label_names(labels: DataFrame, path: str, label: str = "label") -> None:
    labels.select(F.col(label).alias("_id")).distinct().write.mode("overwrite").parquet(path)
