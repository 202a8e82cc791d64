"""Records of evaluation splits that also stand in the training split.

Records are canonicalised (case, punctuation and white space) and hashed, and evaluation hashes are joined with training hashes: of
names, of whole texts, and, for nearly equal texts, of the canonical word runs that neardup indexes. Every overlap is a pair of
`overlap_pairs`; `overlap_counts` counts the same pairs, and the evaluation records with equal text that are too short for them.

A name or text that very many records share makes as many pairs as its training and evaluation records allow, which is the stated
result; such names are joined salted, so that no single task makes all of them.

Defined results: rows in neither kind of split take no part; null names and null or short texts match nothing by that field;
repeated rows of one id count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from . import neardup as N

#: (training, evaluation) values of the split column
TRAINING, EVALUATION = ("training",), ("mixed_test", "time_offset_test")
SALTS = 8


def side_of(split: Column) -> Column:
    """0 for training, 1 for evaluation, null for others."""
    return F.when(split.isin(*TRAINING), 0).when(split.isin(*EVALUATION), 1)


def canonical_text(c: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def canonical_name(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", ""))
    return F.when(t != "", t)


def same_key_pairs(df: DataFrame, id_col: str, key: Column, side: Column) -> DataFrame:
    """(item_id_a, item_id_b), a < b: a training and an evaluation record with equal keys; training records are salted over SALTS tasks a key."""
    d = df.select(F.col(id_col).alias("id"), key.alias("key"), side.alias("side")).where("key is not null and side is not null").distinct()
    t = d.where("side = 0").select("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.col("id").alias("x"))
    e = d.where("side = 1").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("id").alias("y"))
    return t.join(e, ["key", "salt"]).where("x != y").select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b"))


def overlap_pairs(df: DataFrame, id_col: str, name: Column, text: Column, split: Column, scratch: Scratch, jaccard: float = 0.8, k: int = 5, min_words: int = 20) -> DataFrame:
    """All pairs of a training and an evaluation record with the same name or the same or nearly the same text, each once."""
    side = side_of(split)
    d = df.where(side.isNotNull())
    pairs, copies, base = N.similar_pairs(N.signatures(d, F.col(id_col), text, side, k, min_words), scratch, jaccard, cross=True)
    near = N.all_pairs(pairs, copies, cross=True)
    equal = same_key_pairs(base, "id", F.col("whole"), F.col("side"))
    return near.unionByName(equal).unionByName(same_key_pairs(d, id_col, canonical_name(name), side)).distinct()


def _evaluation_rows(df: DataFrame, id_col: str, text: Column, split: Column, source: Column) -> DataFrame:
    """(id, split, source, hit): evaluation records; hit is 1 where the canonical text is also a training text, else null.

    Both sides are reduced to distinct hashes before the join, so copies cost nothing."""
    side = side_of(split)
    t = canonical_text(text)
    d = df.select(F.col(id_col).alias("id"), split.alias("split"), source.alias("source"), side.alias("side"), F.when(t != "", F.sha2(t, 256)).alias("key"))
    train = d.where("side = 0 and key is not null").select("key").distinct().withColumn("hit", F.lit(1))
    return d.where("side = 1").join(train, "key", "left").select("id", "split", "source", "hit")


def exact_overlap_counts(df: DataFrame, id_col: str, text: Column, split: Column, source: Column) -> DataFrame:
    """(split, source, rows, leaked): evaluation records, and those whose canonical text is also a training text; every record counts."""
    return _evaluation_rows(df, id_col, text, split, source).groupBy("split", "source").agg(F.count("*").alias("rows"), F.count("hit").alias("leaked"))


def overlap_counts(df: DataFrame, id_col: str, name: Column, text: Column, split: Column, source: Column, scratch: Scratch, jaccard: float = 0.8, k: int = 5, min_words: int = 20) -> DataFrame:
    """(split, source, rows, leaked, exact, pairs): evaluation records by id; those that overlap with training by name, nearly the same
    or equal canonical text (also one too short for overlap_pairs); those with equal text; and their pairs of overlap_pairs."""
    pairs = scratch.save(overlap_pairs(df, id_col, name, text, split, scratch, jaccard, k, min_words))
    ends = pairs.select(F.col("item_id_a").alias("id")).unionAll(pairs.select("item_id_b")).groupBy("id").agg(F.count("*").alias("n"))
    ev = _evaluation_rows(df, id_col, text, split, source).groupBy("id", "split", "source").agg(F.max("hit").alias("hit"))
    leaked = F.col("hit").isNotNull() | F.col("n").isNotNull()
    return ev.join(ends, "id", "left").groupBy("split", "source").agg(
        F.count("*").alias("rows"), F.count_if(leaked).alias("leaked"), F.count("hit").alias("exact"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pairs"))
