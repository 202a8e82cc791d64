"""Near-duplicate records by an inverted index over positions of hashed word runs, with a count filter and exact verification.

A text is the set of its runs of k words, each hashed to eight bytes, in one order that all texts share: frequent runs last, else by
hash. A text of n runs is indexed at its first n - ceil(t n) + 1 positions. Two texts of x and y runs with Jaccard >= t have at least
a = ceil(t (x + y) / (1 + t)) runs in common. Of the text whose indexed part ends first in the common order, at most ceil(t m) - 1
runs (m: the larger of x and y) lie behind that part, so the index shows at least a - ceil(t m) + 1 common ones: the guaranteed
minimum (34 of 101 for two texts of 200 runs at t = 0.5). Pairs are tallied, those below their minimum dropped, the rest verified on
their whole sets. No pair is missed by chance: the order only decides how many chance pairs are tallied, never which are found.

Runs are counted in every window of WINDOW runs that a task reads; those seen SEEN times in one are summed up over all texts, and the
LISTED most frequent come last in the order, by the power of two of their count, so notices and mastheads are hardly ever indexed.
The few indexed runs that more than VERY of the texts hold are split into cells, each of which pairs two blocks of texts. Exact copies (equal sets) are folded into one
representative before the index is built and unfolded at the end, so a group of copies that holds a third of all rows costs one row
a copy. Texts are read once for each pass; nothing but ids, counts and indexed hashes is stored.

Defined results: null texts and texts with fewer than `min_words` words take part in nothing; the record with the smallest id
represents a set of copies; repeated ids count as one record; an empty table gives an empty result; other columns of the
input are never carried along, so their names cannot clash. Runs are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, small_enough, spread
from . import textkit as K

#: runs in a window, sightings in one that count, runs listed as frequent, share of the texts from which on a run is split, and into how many blocks
WINDOW, SEEN, LISTED, VERY, BLOCKS = 4_000_000, 3, 1 << 19, 0.001, 8


class Frequent:
    """The frequent runs: sorted hashes, the level of each in the common order, and whether it is to be split."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int):
        order = np.argsort(hashes)
        self.hashes, counts = hashes[order], counts[order]
        self.level = np.log2(np.maximum(counts, 2)).astype(np.int8)
        self.split = counts > VERY * texts

    def _at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, x)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == x

    def levels(self, x: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(x), dtype=np.int8)
        at, hit = self._at(x)
        return np.where(hit, self.level[at], 0).astype(np.int8)

    def splits(self, x: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(x), dtype=bool)
        at, hit = self._at(x)
        return hit & self.split[at]


def run_sets(texts: list[str], k: int, min_words: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with at least min_words words: their places in the list, the hash of all their words in order, their distinct run
    hashes in the common order, and offsets."""
    h, _, _, first = K.words(texts)
    runs, begin = K.run_hashes(h, first, k)
    ok = np.diff(first) >= max(min_words, k)
    places = np.flatnonzero(ok)
    keep = np.repeat(ok, np.diff(begin))
    owner, runs = np.repeat(np.cumsum(ok) - 1, np.diff(begin))[keep], runs[keep]
    level = np.zeros(len(runs), dtype=np.int8) if frequent is None else frequent.levels(runs)
    order = np.lexsort((runs, level, owner))
    owner, runs = owner[order], runs[order]
    if len(runs):
        fresh = np.concatenate(([True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])))
        owner, runs = owner[fresh], runs[fresh]
    offsets = np.searchsorted(owner, np.arange(len(places) + 1))
    prefix = K.prefix_hash(K.splitmix(h))
    whole = K.range_hash(prefix, first[places], first[places + 1]) if len(places) else np.zeros(0, dtype=K.U64)
    return places, whole, runs, offsets


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def indexed(n: int, t: float) -> int:
    """How many of n runs are indexed."""
    return n - _ceil(t * n) + 1


def guaranteed(x: int, y: int, t: float) -> int:
    """The least number of common indexed runs of two texts of x and y runs with Jaccard >= t."""
    return _ceil(t * (x + y) / (1 + t)) - _ceil(t * max(x, y)) + 1


class Parts:
    """Run sets of batches of (id, side, text): what the tasks get."""

    def __init__(self, k: int, min_words: int, frequent: Frequent | None = None):
        self.k, self.min_words, self.frequent = k, min_words, frequent

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, sides, texts = K.columns(batch, "id", "side", "text")
            for rows, part in K.chunks(list(zip(ids, sides)), texts, 1 << 19):
                places, whole, runs, offsets = run_sets(part, self.k, self.min_words, self.frequent)
                if len(places):
                    yield np.array([rows[p][0] for p in places], dtype=np.int64), np.array([rows[p][1] for p in places], dtype=np.int32), whole, runs, offsets


_CLASSES = {"id": pa.int64(), "side": pa.int32(), "cls": pa.int64(), "n": pa.int32(), "whole": pa.int64()}


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _classes(parts: Parts):
    """Rows (id, side, cls, n, whole), one a text, and without an id (cls, n): a run and how often a window shows it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, size = [], 0

        def seen() -> pa.RecordBatch:
            runs, count = np.unique(np.concatenate(window), return_counts=True)
            often = count >= SEEN
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), pa.array(runs[often].view(np.int64)), pa.array(count[often].astype(np.int32)), none], names=list(_CLASSES))

        for ids, sides, whole, runs, offsets in parts.of(batches):
            with np.errstate(over="ignore"):
                cls = np.add.reduceat(K.splitmix(runs), offsets[:-1])
            values = (ids, sides, cls.view(np.int64), np.diff(offsets).astype(np.int32), whole.view(np.int64))
            yield _batch({c: (v, t) for (c, t), v in zip(_CLASSES.items(), values)})
            window.append(runs)
            size += len(runs)
            if size >= WINDOW:
                yield seen()
                window, size = [], 0
        if size:
            yield seen()

    return rows


def _postings(parts: Parts, t: float):
    """Rows (key, cell, id, side, n): the indexed runs. A run that is to be split goes to the cells of its text's block with every block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sides, whole, runs, offsets in parts.of(batches):
            n = np.diff(offsets)
            count = np.array([indexed(int(x), t) for x in n])
            owner = np.repeat(np.arange(len(n)), count)
            key = runs[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][owner]]
            cell = np.zeros(len(key), dtype=np.int32)
            if parts.frequent is not None and (wide := parts.frequent.splits(key)).any():
                own, split = np.repeat(owner[wide], BLOCKS), np.repeat(key[wide], BLOCKS)
                block, other = block_of(ids[own]), np.tile(np.arange(BLOCKS), int(wide.sum()))
                owner, key = np.concatenate((owner[~wide], own)), np.concatenate((key[~wide], split))
                cell = np.concatenate((cell[~wide], 1 + np.minimum(block, other) * BLOCKS + np.maximum(block, other))).astype(np.int32)
            yield _batch({"key": (key.view(np.int64), pa.int64()), "cell": (cell, pa.int32()), "id": (ids[owner], pa.int64()), "side": (sides[owner], pa.int32()), "n": (n[owner].astype(np.int32), pa.int32())})

    return rows


def block_of(ids: np.ndarray) -> np.ndarray:
    return (ids % BLOCKS).astype(np.int64)


def _sets(parts: Parts):
    """Rows (id, n, runs): whole sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sides, whole, runs, offsets in parts.of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(offsets).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(runs.view(np.int64)))], names=["id", "n", "runs"])

    return rows


class Records:
    """One table of texts: (id, side, text); side tells the two collections of a cross join apart."""

    def __init__(self, df: DataFrame, id_col: Column, text: Column, side: Column, k: int = 5, min_words: int = 20):
        self.rows = spread(df.select(id_col.cast("bigint").alias("id"), side.cast("int").alias("side"), text.alias("text")).where("id is not null and text is not null"))
        self.k, self.min_words = k, min_words

    def read(self, scratch: Scratch) -> tuple[DataFrame, Frequent]:
        """(id, side, cls, n, whole), one row a text, cls standing for its set of runs; and the frequent runs of all texts."""
        found = scratch.save(self.rows.mapInArrow(_classes(Parts(self.k, self.min_words)), "id bigint, side int, cls bigint, n int, whole bigint"))
        base = found.where("id is not null")
        texts, ids = base.agg(F.count("*"), F.count_distinct("id")).first()
        if texts > ids:  # ids in several rows: the least text of each stands for it
            scratch.drop(found)
            self.rows = self.rows.groupBy("id").agg(F.min(F.struct("side", "text")).alias("r")).select("id", "r.side", "r.text")
            return self.read(scratch)
        counts = scratch.save(found.where("id is null").groupBy(F.col("cls").alias("run")).agg(F.sum("n").alias("n")))
        sizes = counts.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count("*").alias("runs")).collect()  # a few hundred rows
        least, listed = None, 0
        for r in sorted(sizes, reverse=True):
            listed += r.runs
            if listed > LISTED:
                break
            least = r.step
        top = counts.where(F.lit(False) if least is None else F.floor(8 * F.log2("n")) >= least).toPandas()
        return base, Frequent(top["run"].to_numpy(dtype=np.int64).view(K.U64), top["n"].to_numpy(dtype=np.int64), texts)


def signatures(df: DataFrame, id_col: Column, text: Column, side: Column, k: int = 5, min_words: int = 20) -> Records:
    return Records(df, id_col, text, side, k, min_words)


def _joined(df: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    """df left_anti or left_semi joined with a table of n ids, broadcast only if small."""
    return df.join(F.broadcast(ids) if small_enough(n, 64) else ids, "id", how)


def _met(post: DataFrame, t: float, cross: bool) -> DataFrame:
    """(a, b, na, nb): every indexed run that two texts have in common, if their sizes differ by no more than t allows."""
    side = lambda name, s: (post.where(f"side = {s}") if cross else post).select("key", "cell", F.col("id").alias(name), F.col("n").alias(f"n{name}"))
    block = lambda x: F.pmod(x, F.lit(BLOCKS))
    own = 1 + F.least(block("a"), block("b")) * BLOCKS + F.greatest(block("a"), block("b"))
    ok = F.expr("a != b" if cross else "a < b") & ((F.col("cell") == 0) | (F.col("cell") == own)) & (F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9)
    return side("a", 0).join(side("b", 1), ["key", "cell"]).where(ok).select("a", "b", "na", "nb")


def similar_pairs(records: Records, scratch: Scratch, jaccard: float = 0.8, cross: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs, copies and classes.

    pairs (a, b, overlap): representatives with Jaccard >= jaccard; with cross, a is of side 0 and b of side 1.
    copies (id, rep): the other records with the same set (and side) as their representative. classes: of Records.read."""
    t = jaccard
    base, frequent = records.read(scratch)
    key = ["cls", "n", "side"]
    groups = base.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("other")).where("rep != other")
    copies = scratch.save(base.select("id", *key).join(groups.select(*key, "rep"), key).where("id != rep").select("id", "rep"))
    texts = _joined(records.rows, copies.select("id"), copies.count(), "left_anti")
    parts = Parts(records.k, records.min_words, frequent)
    met = _met(texts.mapInArrow(_postings(parts, t), "key bigint, cell int, id bigint, side int, n int"), t, cross)
    tally = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    up = lambda c: F.ceil(c - 1e-9)
    least = up(t * (F.col("na") + F.col("nb")) / (1 + t)) - up(t * F.greatest("na", "nb")) + 1
    pairs = scratch.save(tally.where(F.col("shared") >= least).select("a", "b"))
    scratch.release()
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _joined(texts, involved, 2 * pairs.count(), "left_semi").mapInArrow(_sets(Parts(records.k, records.min_words)), "id bigint, n int, runs array<bigint>")
    a, b = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("runs").alias(f"r{x}")) for x in "ab")
    checked = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ra", "rb")).alias("overlap"))
    found = checked.where(F.col("overlap") >= t * (F.col("na") + F.col("nb") - F.col("overlap")) - 1e-9).select("a", "b", "overlap")
    return found, copies, base


def all_pairs(pairs: DataFrame, copies: DataFrame, cross: bool = False) -> DataFrame:
    """(item_id_a, item_id_b), a < b: pairs of representatives unfolded to their copies, and unless cross the pairs of copies."""
    own = copies.select("rep", "id").union(copies.select("rep", F.col("rep").alias("id"))).distinct()
    m = own.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    n = own.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    wide = pairs.select("a", "b").join(m, "a", "left").join(n, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    if not cross:
        wide = wide.unionByName(own.select("rep", F.col("id").alias("x")).join(own.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y"))
    return wide.select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b"))


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """pairs (a, b) -> (id, group_id): the smallest id each id is linked to, by alternating large-star and small-star rounds."""
    edges = scratch.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = scratch.save(star.where("u != v"))
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = scratch.save(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())
