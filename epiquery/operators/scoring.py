"""Class probabilities from a coefficient table, the label cut-off with ancestor lift, and per-keyword explanations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Scratch, small_enough

#: rows that a task holds at once
CUTOFF, ROWS = 0.65, 65_536


def probabilities(features: DataFrame, coefficients: DataFrame, intercepts: DataFrame, doc: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc, class, p): logistic probability of every class that a text has a feature of; features without a coefficient are dropped.

    With `docs` every text gets every class, those without any known feature from the intercepts alone: as many rows as texts times
    classes, for few classes. The list of classes is put to each text as a whole if it fits the checked bound; a longer one is refused.
    """
    z = features.join(coefficients, "feature").groupBy(doc, "class").agg(F.sum(F.col("coef") * F.col("value")).alias("z"))
    if docs is None:
        z = z.join(intercepts, "class")
    else:
        if not small_enough(intercepts.count(), 64):
            raise ValueError("too many classes to give each text all of them")
        every = [(r["class"], r["intercept"]) for r in intercepts.select("class", "intercept").collect()]
        kind = "array<struct<class: string, intercept: double>>"
        listed = F.from_json(F.lit(json.dumps([{"class": c, "intercept": i} for c, i in every])), kind)
        base = docs.select(doc).distinct().select(doc, F.explode(listed).alias("c")).select(doc, "c.class", "c.intercept")
        z = base.join(z, [doc, "class"], "left")
    return z.select(doc, "class", (1 / (1 + F.exp(-(F.coalesce("z", F.lit(0.0)) + F.col("intercept"))))).alias("p"))


def best_guess(p: DataFrame, ancestors: DataFrame, doc: str, ratio: float = CUTOFF) -> DataFrame:
    """(doc, class, p): classes with at least `ratio` of the best probability, and their ancestors among the classes, which
    get the largest probability of themselves and the chosen descendants. ancestors: (class, ancestor)."""
    top = p.withColumn("top", F.max("p").over(Window.partitionBy(doc)))
    chosen = top.where(F.col("p") >= F.col("top") * ratio).select(doc, "class", "p")
    lifted = chosen.join(ancestors, "class").select(doc, F.col("ancestor").alias("class"), "p")
    own = lifted.select(doc, "class").distinct().join(p, [doc, "class"]).select(doc, "class", "p")
    lifted = lifted.join(own.select(doc, "class"), [doc, "class"], "left_semi")
    return chosen.unionByName(lifted).unionByName(own).groupBy(doc, "class").agg(F.max("p").alias("p"))


def guesses(features: DataFrame, coefficients: DataFrame, intercepts: DataFrame, ancestors: DataFrame, doc: str, ratio: float, scratch: Scratch) -> DataFrame:
    """best_guess of probabilities, for coefficients of most classes: texts with the same features and values are scored once.

    If every class has a coefficient for every feature, and they and the ancestors fit the checked bound, they go to the tasks, which
    give the chosen classes only; else each distinct text gets a row for every class first."""
    x = scratch.save(features.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("x")))
    one = scratch.save(x.groupBy("x").agg(F.min(doc).alias("first")))
    n, names, classes = coefficients.agg(F.count("*"), F.count_distinct("feature"), F.count_distinct("class")).first()
    own = coefficients.select("class").distinct()
    above = scratch.save(ancestors.join(own, "class", "left_semi").join(own.withColumnRenamed("class", "ancestor"), "ancestor", "left_semi").select("class", "ancestor").distinct())
    texts = one.select(F.col("first").alias(doc), "x")
    if n == names * classes and small_enough(n, 8) and small_enough(above.count(), 64):
        kind = T.StructType([T.StructField(doc, features.schema[doc].dataType), T.StructField("class", T.StringType()), T.StructField("p", T.DoubleType())])
        got = texts.mapInArrow(_guessed(coefficients, intercepts, above, doc, ratio), kind)
    else:
        f = texts.select(doc, F.explode("x").alias("f")).select(doc, "f.feature", "f.value")
        got = best_guess(scratch.save(probabilities(f, coefficients, intercepts, doc)), ancestors, doc, ratio)
    got = scratch.save(got)
    return x.join(one, "x").select(doc, "first").join(got.withColumnRenamed(doc, "first"), "first").select(doc, "class", "p")


def _guessed(coefficients: DataFrame, intercepts: DataFrame, above: DataFrame, doc: str, ratio: float):
    place = {r["feature"]: i for i, r in enumerate(coefficients.select("feature").distinct().orderBy("feature").collect())}
    w = coefficients.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("feature", "coef"))).alias("w")).join(intercepts, "class").select("class", F.col("w")["coef"].alias("w"), "intercept").toArrow()
    classes, base = w["class"].to_pylist(), w["intercept"].to_numpy()
    by = np.ascontiguousarray(w["w"].combine_chunks().values.to_numpy().reshape(len(classes), len(place)).T) if classes else np.zeros((0, 0))
    number, up = {c: i for i, c in enumerate(classes)}, {}
    for r in above.collect():
        up.setdefault(number[r["class"]], []).append(number[r["ancestor"]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, x in enumerate(batch.column(1).to_pylist()):
                known = [(place[f["feature"]], f["value"]) for f in x if f["feature"] in place]
                if known:
                    with np.errstate(over="ignore"):
                        p = 1 / (1 + np.exp(-(sum(v * by[j] for j, v in known) + base)))
                    best: dict[int, float] = {}
                    for c in np.flatnonzero(p >= p.max() * ratio).tolist():
                        for a in (c, *up.get(c, ())):
                            best[a] = max(best.get(a, p[a]), p[c])
                    out += [(i, classes[c], v) for c, v in best.items()]
                if len(out) >= ROWS:
                    yield sent(batch, out)
                    out = []
            if out:
                yield sent(batch, out)

    def sent(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        i, c, p = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int32())), pa.array(c, pa.string()), pa.array(p, pa.float64())], names=[doc, "class", "p"])

    return rows


def explanations(guessed: DataFrame, features: DataFrame, base: DataFrame, coefficients: DataFrame, doc: str) -> DataFrame:
    """(doc, class, feature, score, direct): positive contributions coef x value, scaled to unit length and by the probability.

    direct: the keyword stands in the text itself (base: doc, feature); otherwise it was inferred by a link."""
    s = features.join(coefficients, "feature").join(guessed, [doc, "class"]).withColumn("s", F.col("coef") * F.col("value"))
    s = s.withColumn("norm", F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(doc, "class"))))
    s = s.withColumn("score", F.when(F.col("norm") > 0, F.col("s") / F.col("norm")).otherwise(F.col("s")) * F.col("p")).where("score > 0")
    return s.join(base.select(doc, "feature").distinct().withColumn("direct", F.lit(True)), [doc, "feature"], "left").select(doc, "class", "feature", "score", F.coalesce("direct", F.lit(False)).alias("direct"))
