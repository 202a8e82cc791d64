"""Multi-label training: one binary logistic regression a label over sparse keyword features (one-vs-rest).

Texts with the same features are one pattern with counts, which loses nothing. Classes are solved apart, in parallel: each task has
all patterns and some classes, so the distinct patterns must fit the memory of a task; nothing is gathered on the driver. L2 strength
matches C = 1 with a penalised intercept, and each solution is exact up to TOLERANCE in the gradient's norm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import artifacts as A
from ..storage import Scratch
from .diagnose import LabelModel

#: the gradient's norm at a solution, as a part of that at zero; coefficients a task returns; multiplications up to which a Newton step is solved directly
TOLERANCE, CELLS, DIRECT = 1e-6, 2_000_000, 1 << 24


def vocabulary(features: DataFrame, scratch: Scratch) -> DataFrame:
    """(feature, index): sorted distinct features, numbered in order without a global window: by range, then by offset. The ranges are saved first, so
    that a stage that runs again can't number otherwise."""
    d = scratch.save(features.select("feature").distinct().repartitionByRange("feature").sortWithinPartitions("feature").withColumn("part", F.spark_partition_id()))
    local = d.withColumn("r", F.expr("row_number() over (partition by part order by feature) - 1"))
    before = d.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.expr("sum(n) over (order by part) - n")).select("part", "before")
    return local.join(F.broadcast(before), "part").select("feature", (F.col("r") + F.col("before")).alias("index"))


def _solve(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: np.ndarray, pos: np.ndarray, width: int, tolerance: float) -> np.ndarray:
    """Weights, the intercept last, that minimise |w|^2 / 2 plus the log loss of patterns of which n texts exist, pos with the label.

    Newton steps, of few patterns and features solved directly, else by conjugate gradients, until the gradient's norm is at most `tolerance` times that
    at zero (or times 1)."""
    x = None
    if len(n) * (width + 1) ** 2 <= DIRECT:
        x = np.zeros((len(n), width + 1))
        np.add.at(x, (row, col), value)
        x[:, width] = 1
    down = lambda w: np.bincount(row, value * w[col], len(n)) + w[width] if x is None else x @ w
    up = lambda r: np.append(np.bincount(col, value * r[row], width), r.sum()) if x is None else r @ x
    share = lambda z: 0.5 * (1 + np.tanh(0.5 * z))

    def state(w: np.ndarray) -> tuple:
        z = down(w)
        return w, share(z), 0.5 * w @ w + (n * np.logaddexp(0, z) - pos * z).sum(), w + up(n * share(z) - pos)

    w, p, f, g = state(np.zeros(width + 1))
    least = tolerance * max(1.0, np.linalg.norm(g))
    while (size := np.linalg.norm(g)) > least:
        curve = n * p * (1 - p)
        step = _step(curve, g, size, row, col, value, width, down, up) if x is None else -np.linalg.solve(np.eye(len(w)) + x.T @ (curve[:, None] * x), g)
        slope, t = g @ step, 1.0
        while True:
            new = state(w + t * step)
            if new[2] <= f + 1e-4 * t * slope or t == 1 and np.linalg.norm(new[3]) < 0.5 * size:
                break
            t /= 2
            if t < 1e-12:
                raise ArithmeticError(f"gradient norm {size} can't be brought to {least}")
        w, p, f, g = new
    return w


def _step(curve: np.ndarray, g: np.ndarray, size: float, row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int, down, up) -> np.ndarray:
    """A Newton step by conjugate gradients, the more exact the smaller the gradient g."""
    scale = 1 + np.append(np.bincount(col, value * value * curve[row], width), curve.sum())
    step, rest = np.zeros_like(g), -g
    way = rest / scale
    energy = rest @ way
    for _ in range(10 * len(g)):
        turned = way + up(curve * down(way))
        far = energy / (way @ turned)
        step, rest = step + far * way, rest - far * turned
        if np.linalg.norm(rest) <= min(0.1, np.sqrt(size)) * size:
            break
        energy, before = rest @ (rest / scale), energy
        way = rest / scale + energy / before * way
    return step


def _solve_each(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: np.ndarray, positive: dict[str, np.ndarray], width: int, tolerance: float) -> list[np.ndarray]:
    """_solve for each class; classes with the same positives are one problem."""
    solved: dict[bytes, np.ndarray] = {}
    for pos in positive.values():
        if (k := pos.tobytes()) not in solved:
            solved[k] = _solve(row, col, value, n, pos, width, tolerance)
    return [solved[pos.tobytes()] for pos in positive.values()]


def one_vs_rest(features: DataFrame, labels: DataFrame, doc: str, scratch: Scratch, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(coefficients (class, feature, coef), intercepts (class, intercept)) from (doc, feature, value) and (doc, label).

    Every class has a coefficient for every feature of the texts."""
    spark = features.sparkSession
    docs = scratch.save(features.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("x")))
    patterns = scratch.save(docs.groupBy("x").agg(F.min(doc).alias("pattern"), F.count("*").alias("n")))
    y = labels.select(doc, F.col("label").alias("class")).distinct().join(docs, doc).groupBy("x", "class").agg(F.count("*").alias("pos"))
    y = scratch.save(y.join(patterns, "x").select("class", "pattern", "pos"))
    width, classes = features.select("feature").distinct().count(), y.select("class").distinct().count()
    parts = max(spark.sparkContext.defaultParallelism, -(-classes * (width + 1) // CELLS))
    every = patterns.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("part", "pattern", "n", F.col("x")["feature"].alias("feature"), F.col("x")["value"].cast("array<double>").alias("value"))
    own = y.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int"))

    def solve(x: pa.Table, own: pa.Table) -> pa.Table:
        x = x.sort_by("pattern")  # the same problem has the same solution in every task
        place = {k: i for i, k in enumerate(x["pattern"].to_pylist())}
        lists = x["feature"].combine_chunks()
        lengths = np.array([len(v) for v in lists], dtype=np.int64)
        flat = [f for v in lists.to_pylist() for f in v]
        names = sorted(set(flat))
        number = {f: i for i, f in enumerate(names)}
        row, col = np.repeat(np.arange(len(lengths)), lengths), np.array([number[f] for f in flat], dtype=np.int64)
        value = np.array([v for vs in x["value"].to_pylist() for v in vs], dtype=np.float64)
        n, positive = x["n"].to_numpy().astype(np.float64), {}
        for c, k, pos in zip(own["class"].to_pylist(), own["pattern"].to_pylist(), own["pos"].to_pylist()):
            positive.setdefault(c, np.zeros(len(n)))[place[k]] += pos
        coef = _solve_each(row, col, value, n, positive, len(names), tolerance)
        each = [c for c in positive for _ in range(len(names) + 1)]
        return pa.table({"class": pa.array(each, pa.string()), "feature": pa.array((names + [None]) * len(coef), pa.string()), "coef": pa.array(np.concatenate(coef) if coef else [], pa.float64())})

    w = scratch.save(every.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(solve, "class string, feature string, coef double"))
    return w.where("feature is not null"), w.where("feature is null").select("class", F.col("coef").alias("intercept"))


def trained_model(labels: DataFrame, items: DataFrame, item: str, text: Column, diseases: Column, folder: str, scratch: Scratch, features: DataFrame | None = None) -> LabelModel:
    """A label model with coefficients learned from items: features, training, the next version of the artifacts in `folder`, and that version loaded.

    Items without any feature take no part, as those that are all zero; labels count without their ancestors. Given are the features of the items
    if they are there already; else the texts are read for them."""
    spark = items.sparkSession
    f = features
    if f is None:
        m = LabelModel(labels, scratch)
        f = m.features(m.base(items, item, text), item)
    y = items.select(item, F.explode(diseases).alias("label")).where("label is not null")
    weights, intercepts = one_vs_rest(f, y, item, scratch)
    A.save(weights, folder, "coefficients-")
    A.save(intercepts, folder, "intercepts-")
    return LabelModel(labels, scratch, trained=(A.load(spark, folder, "coefficients-"), A.load(spark, folder, "intercepts-")))
