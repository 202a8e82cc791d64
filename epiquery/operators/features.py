"""Keyword features of texts: n-gram counts against a lexicon, link expansion, clamping, renaming.

Feature tables are long: (doc, feature, value), one row per feature a text has. Texts without features have no row, so the
zero-vector filter is a semi-join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..storage import Scratch, small_enough
from .hierarchy import inferred_pairs

#: texts of a batch that are counted at once
LINKED, TEXTS = "[linked] ", 500
#: X.TOKEN for Python, whose \w holds the same letters and digits
TOKEN = r"http[^ \t\n\x0b\f\r]*\w|\w+"


def token_counts(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(token, docs, total)."""
    return docs.select(doc, F.explode(X.tokens(text)).alias("token")).groupBy(doc, "token").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))


def keyword_table(keywords: DataFrame, keyword: str, most: int = 5) -> DataFrame:
    """(keyword, first, n) of the distinct normalised keywords of up to `most` tokens."""
    k = keywords.select(X.tokens(F.col(keyword)).alias("t")).where(f"size(t) between 1 and {most}")
    return k.select(F.array_join("t", " ").alias("keyword"), F.col("t")[0].alias("first"), F.size("t").alias("n")).distinct()


def keyword_counts(docs: DataFrame, doc: str, text: Column, keywords: DataFrame, keyword: str) -> DataFrame:
    """(doc, keyword, n): how often each keyword of up to five tokens stands in each text, overlaps included.

    A lexicon of a checked size goes to the tasks, which read each text once and give its hits only. Of a larger one a bitmap of its keywords'
    hashes goes there (as for spans), and only the runs that pass it, counted by text, meet the keywords."""
    from . import spans as SP

    k = keyword_table(keywords, keyword)
    kind, size = docs.schema[doc].dataType, k.count()
    counted, texts = T.StructType([T.StructField(doc, kind), T.StructField("keyword", T.StringType()), T.StructField("n", T.LongType())]), docs.select(doc, F.lower(text).alias("t")).where("t is not null")
    if small_enough(size, 400):
        index: dict[str, list[tuple[int, str]]] = {}
        for r in k.collect():
            index.setdefault(r["first"], []).append((r["n"], r["keyword"]))
        found = texts.mapInArrow(_counted(index, doc), counted)
    else:
        bits = min(SP.MOST_BITS, 1 << max(15, (size * SP.BITS_EACH - 1).bit_length()))
        found = texts.mapInArrow(_likely(SP._bitmap(k.withColumnRenamed("keyword", "k"), bits), bits, doc), counted).join(k.select("keyword"), "keyword", "left_semi")
    return found.groupBy(doc, "keyword").agg(F.sum("n").alias("n"))


def _counted(index: dict[str, list[tuple[int, str]]], doc: str):
    token = re.compile(TOKEN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, words, counts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                toks, hits = token.findall(t), Counter()
                for at in [p for p, w in enumerate(toks) if w in index]:
                    for n, k in index[toks[at]]:
                        if n == 1 or toks[at : at + n] == k.split(" "):
                            hits[k] += 1
                place += [i] * len(hits)
                words += hits.keys()
                counts += hits.values()
            if place:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int32())), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=[doc, "keyword", "n"])

    return rows


def _likely(bitmap: bytes, bits: int, doc: str):
    """(doc, keyword, n) of the runs of up to five tokens whose hash is in the bitmap."""
    token, last = re.compile(TOKEN), bits - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def there(x: str) -> int:
            h = crc32(x.encode()) & last
            return bitmap[h >> 3] >> (h & 7) & 1

        class Begins(dict):
            def __missing__(self, w: str) -> int:
                self[w] = found = there(" " + w)
                return found

        for batch in batches:
            begins = Begins()
            for b in range(0, batch.num_rows, TEXTS):
                part, place, words, counts = batch.slice(b, TEXTS), [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    toks, hits = token.findall(t), Counter()
                    for at in [p for p, w in enumerate(toks) if begins[w]]:
                        for e in range(at + 1, min(at + 5, len(toks)) + 1):
                            if there(k := " ".join(toks[at:e])):
                                hits[k] += 1
                    place += [i] * len(hits)
                    words += hits.keys()
                    counts += hits.values()
                if place:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int32())), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=[doc, "keyword", "n"])

    return rows


def overlaid(insensitive: DataFrame, sensitive: DataFrame, doc: str) -> DataFrame:
    """Counts of case-sensitive keywords replace those of the same feature counted without case."""
    a, b = insensitive.select(doc, "keyword", F.col("n").alias("a")), sensitive.select(doc, "keyword", F.col("n").alias("b"))
    return a.join(b, [doc, "keyword"], "full").select(doc, "keyword", F.coalesce("b", "a").alias("n"))


def linked(features: DataFrame, links: DataFrame, doc: str, weight: float = 1.0) -> DataFrame:
    """(doc, feature, value): direct counts plus weight times the counts of the keywords linked to a feature, one hop.

    links: (keyword, linked), any number a keyword."""
    direct = features.select(doc, F.col("keyword").alias("feature"), F.col("n").cast("double").alias("value"))
    by_link = features.join(links.select("keyword", "linked").distinct(), "keyword").select(doc, F.concat(F.lit(LINKED), "linked").alias("feature"), (F.col("n").cast("double") * weight).alias("value"))
    return direct.unionByName(by_link).groupBy(doc, "feature").agg(F.sum("value").alias("value"))


def clamped(features: DataFrame, most: float = 1.0) -> DataFrame:
    return features.withColumn("value", F.least(F.lit(float(most)), "value"))


def resolved_renames(mapping: DataFrame, scratch: Scratch) -> DataFrame:
    """(keyword, target) of renames (keyword, target): chains are followed to their end; in or before a cycle the smallest name met is the target."""
    met = inferred_pairs(mapping.select(F.col("keyword").alias("label"), F.col("target").alias("parent")), scratch)
    ends = met.groupBy("label").agg(F.max_by("ancestor", "distance").alias("last"), F.min("ancestor").alias("least"))
    keys = mapping.select(F.col("keyword").alias("last"), F.lit(True).alias("more")).distinct()
    return ends.join(keys, "last", "left").select(F.col("label").alias("keyword"), F.when(F.col("more"), F.col("least")).otherwise(F.col("last")).alias("target"))


def renamed(features: DataFrame, mapping: DataFrame, doc: str) -> DataFrame:
    """Features renamed by a resolved mapping (keyword, target) and their values summed."""
    f = features.join(mapping, "keyword", "left").select(doc, F.coalesce("target", "keyword").alias("keyword"), "n")
    return f.groupBy(doc, "keyword").agg(F.sum("n").alias("n"))


def without_zero_vectors(docs: DataFrame, features: DataFrame, doc: str) -> DataFrame:
    """The records whose features sum to more than 0."""
    return docs.join(features.groupBy(doc).agg(F.sum("value").alias("s")).where("s > 0").select(doc), doc, "left_semi")
