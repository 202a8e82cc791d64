"""Mining keyword hierarchies from triples and edge tables (sub-class closures, label joins, definition predicates)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

# Predicates whose objects are labels, relations in definitions and the pattern of their values, notes and hosts in label suffixes.
LABEL_PREDICATES = ["hasNarrowSynonym", "hasRelatedSynonym", "hasExactSynonym", "label"]
RELATIONS = ["has_symptom", "transmitted_by", "has_material_basis_in", "results_in", "located_in"]
VALUE = r"\s{1,2}(?:the\s{1,2})?(.+?)(?:,|\.|\s(?:or|and|\w+_\w+)\b)"
NOTES = ["context-dependent category", "qualifier value", "clinical", "acute", "body structure", "category"]
HOSTS = ["Avian", "Bovine", "Caprine", "Canine", "Cervine", "Feline", "Swine", "Non-Human Primate", "Human", "Honeybee", "Fish", "Rodent", "Equine", "Lagomorph"]


def labels_of(triples: DataFrame) -> DataFrame:
    """(subject, label)."""
    return triples.where(F.col("predicate").isin(LABEL_PREDICATES)).select("subject", F.col("object").alias("label")).distinct()


def closure(edges: DataFrame, child: str, parent: str, scratch: Scratch) -> DataFrame:
    """(child, ancestor) over all paths of one step or more, self-loops left out; cycles end by themselves.

    Distances double each round, so a hierarchy of depth d takes about log2 d rounds of a join and a distinct."""
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("a")).where("c is not null and a is not null and c <> a").distinct()
    known = scratch.save(e)
    n = known.count()
    while True:
        more = known.join(known.select(F.col("c").alias("a"), F.col("a").alias("a2")), "a").select("c", F.col("a2").alias("a")).where("c <> a")
        known = scratch.save(known.unionByName(more).distinct())
        now = known.count()
        if now == n:
            return known.select(F.col("c").alias(child), F.col("a").alias("ancestor"))
        n = now


def within(pairs: DataFrame, child: str, root: str) -> DataFrame:
    """Closure pairs of the nodes below `root`, the root itself left out as an ancestor. A root that nothing leads to is an error, raised when
    the first row is read."""
    below = pairs.where((F.col("ancestor") == root) & (F.col(child) != root)).select(child).distinct()
    inside = pairs.join(below, child, "left_semi").join(below.select(F.col(child).alias("ancestor")), "ancestor", "left_semi").select(child, "ancestor")
    n = pairs.where(F.col("ancestor") == root).limit(1).agg(F.count("*").alias("n"))
    missing = n.where("n = 0").select(F.raise_error(F.lit(f"no way leads to {root}")).cast("string").alias(child)).select(child, F.col(child).alias("ancestor"))
    return inside.unionByName(missing)


def linked_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, keyword, linked): every label of a subject with every label of its ancestors."""
    up = pairs.withColumnRenamed("ancestor", "a").join(labels.select(F.col("subject").alias("a"), F.col("label").alias("linked")), "a")
    return labels.withColumnRenamed("label", "keyword").join(up.select("subject", "linked"), "subject").select("subject", "keyword", "linked").distinct()


def levels(edges: DataFrame, roots: DataFrame, node: str, child: str, parent: str, most: int = 3) -> DataFrame:
    """(node, level): what is reached from the roots in at most `most` steps down, at its lowest level."""
    frontier = roots.select(F.col(node).alias("n"))
    out = frontier.withColumn("level", F.lit(0))
    for level in range(1, most + 1):
        frontier = edges.join(frontier, F.col(parent) == F.col("n")).select(F.col(child).alias("n")).distinct()
        out = out.unionByName(frontier.withColumn("level", F.lit(level)))
    return out.groupBy("n").agg(F.min("level").alias("level")).withColumnRenamed("n", node)


def definition_relations(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, relation, value): values that follow a relation in a definition, up to a comma, stop, "or", "and" or a next relation. One pass."""
    one = lambda r: F.transform(F.regexp_extract_all(text, F.lit(f"(?i){r}{VALUE}"), F.lit(1)), lambda v: F.struct(F.lit(r).alias("relation"), v.alias("value")))
    return df.select(key, F.explode(F.concat(*map(one, RELATIONS))).alias("r")).select(key, "r.relation", "r.value")


def label_suffix(label: Column) -> tuple[Column, Column, Column]:
    """(label, note, host): a bracket that names a listed note or host ends the label, case aside; any other stays part of it."""
    rx = r"(?i)^(.+?)\s+\((" + "|".join(re.escape(x) for x in NOTES + HOSTS) + r")\)"
    word = F.regexp_extract(label, rx, 2)
    is_host = F.lower(word).isin([h.lower() for h in HOSTS])
    return F.when(word != "", F.regexp_extract(label, rx, 1)).otherwise(label), F.when((word != "") & ~is_host, word), F.when(is_host, word)


def instances(triples: DataFrame, label: str = "label", synonym: str = "hasExactSynonym") -> DataFrame:
    """(subject, label, synonym): every label of a subject with each of its synonyms, null where it has none (an optional pattern)."""
    of = lambda p, name: triples.where(F.col("predicate") == p).select("subject", F.col("object").alias(name)).distinct()
    return of(label, "label").join(of(synonym, "synonym"), "subject", "left").select("subject", "label", "synonym")


def hyponyms(edges: DataFrame, roots: DataFrame, lemma: Column, child: str = "label", parent: str = "parent", most: int = 3) -> DataFrame:
    """(node, level, lemma, ancestors): what is reached from the roots (node) in at most `most` steps down, over every way, with the lemmas
    met on the way, the nearest first. lemma: an expression over a column `node`."""
    named = lambda d: d.withColumn("lemma", lemma)
    frontier = named(roots.select("node", F.lit(0).alias("level"), F.array().cast("array<string>").alias("ancestors")))
    out = frontier
    for level in range(1, most + 1):
        up = frontier.select(F.col("node").alias(parent), F.concat(F.array("lemma"), "ancestors").alias("ancestors"))
        frontier = named(edges.join(up, parent).select(F.col(child).alias("node"), F.lit(level).alias("level"), "ancestors"))
        out = out.unionByName(frontier)
    return out.select("node", "level", "lemma", "ancestors")


def normalised_join(left: DataFrame, left_label: str, right: DataFrame, right_label: str, squash) -> DataFrame:
    """left x right on labels equal after squash()."""
    a, b = left.withColumn("__k", squash(F.col(left_label))), right.withColumn("__k", squash(F.col(right_label)))
    return a.join(b, "__k").where("__k <> ''").drop("__k")
