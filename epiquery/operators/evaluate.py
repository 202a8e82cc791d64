"""Precision, recall and F-score of multi-label predictions: by label, macro and micro. 0/0 is 0.

Truth and prediction are long tables (doc, label); repeated pairs count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def by_label(truth: DataFrame, predicted: DataFrame, doc: str) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f) over the labels of either table."""
    t, p = truth.select(doc, "label").distinct().withColumn("t", F.lit(1)), predicted.select(doc, "label").distinct().withColumn("p", F.lit(1))
    c = t.join(p, [doc, "label"], "full").groupBy("label").agg(F.count_if(F.expr("t = 1 and p = 1")).alias("tp"), F.count_if(F.expr("t is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f"))


def weakest_first(labels: DataFrame) -> DataFrame:
    """labels (of by_label) with `place`, from 1, by F-score, then label; a report of all labels."""
    return labels.withColumn("place", F.row_number().over(Window.orderBy("f", "label")).cast("bigint"))


def macro(labels: DataFrame) -> DataFrame:
    return labels.agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("f"), F.lit(0.0)).alias("f"), F.count("*").alias("labels"))


def micro(labels: DataFrame) -> DataFrame:
    s = labels.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f"))


def misclassified(truth: DataFrame, predicted: DataFrame, doc: str, first: int = 100) -> DataFrame:
    """(doc, truth, predicted) of those of the first `first` texts of the truth whose label sets differ."""
    docs = truth.select(doc).distinct().orderBy(doc).limit(first)
    s = lambda d, n: d.join(docs, doc, "left_semi").groupBy(doc).agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias(n))
    both = docs.join(s(truth, "truth"), doc, "left").join(s(predicted, "predicted"), doc, "left").select(doc, *[F.coalesce(c, F.lit("")).alias(c) for c in ("truth", "predicted")])
    return both.where("truth <> predicted")


def by_set(truth: DataFrame, predicted: DataFrame, doc: str, part: str) -> DataFrame:
    """(part, labels, tp, fp, fn, macro_precision, macro_recall, macro_f, micro_precision, micro_recall, micro_f) of tables (doc, label, part)."""
    keys = [part, doc, "label"]
    t, p = truth.select(keys).distinct().withColumn("t", F.lit(1)), predicted.select(keys).distinct().withColumn("p", F.lit(1))
    c = t.join(p, keys, "full").groupBy(part, "label").agg(F.count_if(F.expr("t = 1 and p = 1")).alias("tp"), F.count_if(F.expr("t is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.select(part, "tp", "fp", "fn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f"))
    g = c.groupBy(part).agg(F.count("*").alias("labels"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], *[F.avg(x).alias(f"macro_{x}") for x in ("precision", "recall", "f")])
    return g.select("*", _ratio(tp, tp + fp).alias("micro_precision"), _ratio(tp, tp + fn).alias("micro_recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f"))
