"""The engine's tasks from end to end: mining a lexicon, training, evaluating, and diagnosing, on tables and through artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import artifacts as A
from ..storage import Scratch
from . import diagnose as D
from . import evaluate as V
from . import lexicon as L
from . import train as T


def mine(synsets: list[DataFrame], folder: str, excluded: list[str] | None = None, prefix: str = "keywords-") -> dict[str, int]:
    """Builds the lexicon of synset tables (synonyms, parent_synonyms, category), refuses what is no keyword, saves it as the next version, and
    counts the keywords that are new and removed since the last one, case aside."""
    every = synsets[0]
    for s in synsets[1:]:
        every = every.unionByName(s)
    spark = every.sparkSession
    built = L.checked(L.build(L.excluding(every, excluded) if excluded else every))
    before = A.versions(spark, folder, prefix)
    A.save(built, folder, prefix)
    now = A.load(spark, folder, prefix)
    low = lambda d: d.select(F.lower("keyword").alias("k")).distinct()
    old = low(spark.read.parquet(before[-1][1])) if before else low(now).where("false")
    both = low(now).withColumn("a", F.lit(1)).join(old.withColumn("b", F.lit(1)), "k", "full")
    n = both.agg(F.count_if(F.col("b").isNull()), F.count_if(F.col("a").isNull())).first()
    return {"keywords": now.count(), "new": n[0], "removed": n[1]}


def train(labels: DataFrame, items: DataFrame, item: str, text: Column, diseases: Column, folder: str, scratch: Scratch) -> D.LabelModel:
    """See train.trained_model."""
    return T.trained_model(labels, items, item, text, diseases, folder, scratch)


def loaded(labels: DataFrame, folder: str, scratch: Scratch, version: int | None = None) -> D.LabelModel:
    """The newest trained model of a folder, or the version asked for; an error if an artifact is missing."""
    spark = labels.sparkSession
    return D.LabelModel(labels, scratch, trained=(A.load(spark, folder, "coefficients-", version), A.load(spark, folder, "intercepts-", version)))


def evaluate(model: D.LabelModel, items: DataFrame, item: str, text: Column, diseases: Column, part: str, features: DataFrame | None = None) -> DataFrame:
    """Scores of a model over each part of the items (V.by_set); true labels count with those they imply. Texts whose features are given aren't read."""
    found = D.diagnose(items, item, text, model) if features is None else D.by_features(features, item, model)
    guessed = model.scratch.save(found.select(item, F.col("class").alias("label")))
    own = items.select(item, F.explode(diseases).alias("label")).where("label is not null").distinct()
    truth = model.scratch.save(own.unionByName(own.join(model.pairs, "label").select(item, F.col("ancestor").alias("label"))).distinct())
    parts = items.select(item, part).distinct()
    return V.by_set(truth.join(parts, item), guessed.join(parts, item), item, part)
