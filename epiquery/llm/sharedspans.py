"""Long exact spans shared between records: winnowed anchors, extension both ways, maximal repeats.

A shared span of `least` characters always contains a common anchor (anchors are the winnowing minima of SEED-grams over
windows of least - SEED + 1). Anchors that stand in one text only are dropped by a count. The rest, few, get hashes of
STEPS wider contexts, of which a shared span round the anchor has at least one in common; pairs of texts that pass are
compared along the anchors' diagonals, which gives every common run exactly.

An anchor that stands in more than HOT texts would give quadratically many pairs. Its texts take another, equally exact way:
all least-character windows round the anchor are hashed twice, independently, and a window whose 128 bits stand in two texts is shared:
linear work, whatever the number of texts. Exact copies of a text are folded first.

Defined results: null texts and texts shorter than `least` share nothing; a repeat inside one record does not count, but the same
text in another row does; positions are code points; copies share their whole text; repeated ids count as one record; an
empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, small_enough, spread
from . import textkit as K

SEED, HOT, STEPS = 100, 64, 3
INDEX, SPAN = 26, 1 << 25


def winnow(h: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the (rightmost) minimum of h in some window of w positions starting where `valid`; by the upper 64 - INDEX bits.

    Windows are taken SPAN at a time, so that a place within a span fits INDEX bits, however long a text is."""
    n = len(h)
    if n < w or not valid.any():
        return np.zeros(0, dtype=np.int64)
    found = [lo + _winnowed(h[lo : lo + SPAN + w - 1], valid[lo : lo + SPAN], w) for lo in range(0, n - w + 1, SPAN)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _winnowed(h: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    mask = K.U64((1 << INDEX) - 1)
    v = (h & ~mask) | (mask - np.arange(n, dtype=K.U64))
    padded = np.full(-(-n // w) * w, ~K.U64(0), dtype=K.U64)
    padded[:n] = v
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[: n - w + 1], ahead[w - 1 : n])[valid[: n - w + 1]]
    low = low[np.concatenate((np.ones(min(1, len(low)), dtype=bool), low[1:] != low[:-1]))]
    return np.unique((mask - (low & mask)).astype(np.int64))


def anchors_of(texts: list[str], least: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of all anchors."""
    cp, starts = K.joined(texts)
    n = len(cp) - seed + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=K.U64),)
    prefix = K.prefix_hash(K.mix(cp))
    at = np.arange(n)
    h = K.range_hash(prefix, at, at + seed)
    valid = np.zeros(n, dtype=np.int32)
    begin, end = starts[:-1], starts[1:] - 1 - least + 1
    ok = end > begin
    valid += np.bincount(begin[ok], minlength=n)[:n].astype(np.int32)
    valid -= np.bincount(end[ok], minlength=n)[:n].astype(np.int32)
    pos = winnow(h, np.cumsum(valid) > 0, least - seed + 1)
    text = np.searchsorted(starts, pos, side="right") - 1
    return text, pos - starts[text], h[pos]


def long_runs(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) in a of at least `least` elements with a[i] == b[i - shift]."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi - lo < least:
        return []
    differ = np.flatnonzero(a[lo:hi] != b[lo - shift : hi - shift])
    edges = np.concatenate(([-1], differ, [hi - lo]))
    gap = np.diff(edges) - 1
    return [(lo + int(edges[i]) + 1, lo + int(edges[i + 1])) for i in np.flatnonzero(gap >= least)]


def _anchor_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in K.chunks(*K.columns(batch, "id", "text"), 1 << 19):
                text, pos, h = anchors_of(texts, least)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[text]), pa.array(pos), pa.array(h.view(np.int64))], names=["id", "pos", "h"])

    return rows


def _compare(least: int):
    """Rows (a, b, shifts, ta, tb) -> (id, start, end): the shared runs in either text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for a, b, shifts, ta, tb in zip(*K.columns(batch, "a", "b", "shifts", "ta", "tb")):
                x, y = K.codepoints(ta), K.codepoints(tb)
                for d in set(shifts):
                    for s, e in long_runs(x, y, d, least):
                        out += [(a, s, e), (b, s - d, e - d)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64()))], names=["id", "start", "end"])

    return rows


def _contexts(least: int):
    """Rows (id, text, at: [(pos, h)]) -> (id, pos, h, c0, c1, c2): hashes of contexts that lie more and more to the left.

    With step = (least - SEED) / STEPS, a span that goes L to the left and R to the right of the anchor, L + R >= least - SEED,
    covers context i = min(STEPS - 1, L // step). Contexts that leave the text are null."""
    step = (least - SEED) // STEPS
    size = SEED + step * (STEPS - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(3 + STEPS)]
            for i, text, at in zip(*K.columns(batch, "id", "text", "at")):
                cp = K.codepoints(text)
                prefix, pos = K.prefix_hash(K.mix(cp)), np.array([x["pos"] for x in at], dtype=np.int64)
                out[0] += [i] * len(at)
                out[1] += pos.tolist()
                out[2] += [x["h"] for x in at]
                for c in range(STEPS):
                    b = pos - step * c
                    ok = (b >= 0) & (b + size <= len(cp))
                    h = np.zeros(len(b), dtype=K.U64)
                    h[ok] = K.range_hash(prefix, b[ok], b[ok] + size)
                    out[3 + c] += [int(x) if y else None for x, y in zip(h.view(np.int64), ok)]
            if out[0]:
                types = (pa.int64(), pa.int64(), *[pa.int64()] * (1 + STEPS))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["id", "pos", "h", *[f"c{c}" for c in range(STEPS)]])

    return rows


def _windows(least: int):
    """Rows (id, text, at) -> (id, start, w, t): all windows of `least` characters that contain one of the anchors at `at`, by two independent
    hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, at in zip(*K.columns(batch, "id", "text", "at")):
                cp = K.codepoints(text)
                spread = np.unique(np.add.outer(np.array(at), np.arange(-(least - SEED), 1)).ravel())
                spread = spread[(spread >= 0) & (spread + least <= len(cp))]
                if len(spread):
                    h, again = (K.range_hash(K.prefix_hash(x), spread, spread + least) for x in (K.mix(cp), K.splitmix(K.mix(cp))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, dtype=np.int64)), pa.array(spread), pa.array(h.view(np.int64)), pa.array(again.view(np.int64))], names=["id", "start", "w", "t"])

    return rows


class SharedSpans:
    """The stages of the search over one table of (id, text)."""

    def __init__(self, df: DataFrame, id_col: Column, text: Column, scratch: Scratch, least: int = 200):
        self.scratch, self.least = scratch, least
        d = spread(df.select(id_col.cast("bigint").alias("id"), text.alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least)))
        keyed = d.select("id", F.md5(F.col("text").cast("binary")).alias("key"), F.length("text").alias("n"))
        classes = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep != last")
        #: (id, rep, n): all members of groups of copies, the representative too
        self.copies = scratch.save(keyed.join(classes.select("key", "rep"), "key").select("id", "rep", "n").distinct())
        extra = self.copies.where("id != rep").select("id")
        self.reps = d.join(self._hint(extra, self.copies.count(), 16), "id", "left_anti")
        self._anchors()

    def _hint(self, df: DataFrame, rows: int, width: int) -> DataFrame:
        return F.broadcast(df) if small_enough(rows, width * 4) else df

    def _anchors(self) -> None:
        found = self.scratch.save(self.reps.mapInArrow(_anchor_rows(self.least), "id bigint, pos bigint, h bigint"))
        shared = found.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("h", "n")
        shared = self.scratch.save(shared)
        kept = self.scratch.save(found.join(self._hint(shared, shared.count(), 16), "h"))
        self.hot = kept.where(F.col("n") > HOT)
        self.any_hot = not self.hot.isEmpty()
        at = kept.where(F.col("n") <= HOT).groupBy("id").agg(F.collect_list(F.struct("pos", "h")).alias("at"))
        rows = self.reps.dropDuplicates(["id"]).join(self._hint(at, kept.count(), 64), "id")
        cold = rows.mapInArrow(_contexts(self.least), "id bigint, pos bigint, h bigint, " + ", ".join(f"c{c} bigint" for c in range(STEPS)))
        x, y = (cold.withColumnsRenamed({"id": i, "pos": p} | {f"c{c}": f"{i}{c}" for c in range(STEPS)}) for i, p in (("a", "pa"), ("b", "pb")))
        alike = " or ".join(f"a{c} = b{c}" for c in range(STEPS))
        met = x.join(y, "h").where(f"a < b and ({alike})").groupBy("a", "b", (F.col("pa") - F.col("pb")).alias("shift")).agg(F.count("*").alias("n"))
        #: (a, b, n, shifts): pairs of texts that share anchors in context, and the diagonals these lie on
        self.pairs = self._saved(met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.collect_list("shift").alias("shifts")))

    def _saved(self, df: DataFrame) -> DataFrame:
        out = self.scratch.save(df)
        self.scratch.release()
        return out

    def runs(self, pairs: DataFrame) -> DataFrame:
        """(id, start, end) of all runs the pairs share, in either text."""
        who = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        texts = self.reps.join(self._hint(who, 2 * pairs.count(), 16), "id", "left_semi").dropDuplicates(["id"])
        a, b = (texts.select(F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "ta"), ("b", "tb")))
        return pairs.select("a", "b", "shifts").join(a, "a").join(b, "b").mapInArrow(_compare(self.least), "id bigint, start bigint, end bigint")

    def hot_runs(self, done: DataFrame | None = None) -> DataFrame | None:
        """(id, start, end) of shared windows round anchors that stand in many texts."""
        if not self.any_hot:
            return None
        at = self.hot.groupBy("id").agg(F.collect_list("pos").alias("at"))
        w = self.scratch.save(self.reps.join(at, "id").mapInArrow(_windows(self.least), "id bigint, start bigint, w bigint, t bigint"))
        shared = w.groupBy("w", "t").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("w", "t")
        return w.join(shared, ["w", "t"], "left_semi").select("id", "start", (F.col("start") + self.least).alias("end"))

    def found(self) -> DataFrame:
        """(id): records with a shared span. Each text is first compared with the one it shares most anchors with; only what that
        leaves open is compared with all others."""
        ends = self.pairs.select("a", "b", "n", "shifts", F.explode(F.array("a", "b")).alias("id"))
        best = ends.groupBy("id").agg(F.max(F.struct("n", "a", "b", "shifts")).alias("m")).select("m.*").dropDuplicates(["a", "b"])
        best = self.scratch.save(best)
        first = self.scratch.save(self.runs(best).select("id").distinct())
        n = first.count()
        fa, fb = (self._hint(first.select(F.col("id").alias(c), F.lit(True).alias(f"f{c}")), n, 16) for c in ("a", "b"))
        open_ = self.pairs.join(self._hint(best.select("a", "b"), best.count(), 16), ["a", "b"], "left_anti")
        rest = self.scratch.save(open_.join(fa, "a", "left").join(fb, "b", "left").where("fa is null or fb is null").select("a", "b", "shifts"))
        ids = first.union(self.copies.select("id"))
        if not rest.isEmpty():
            ids = ids.union(self.runs(rest).select("id"))
        hot = self.hot_runs()
        if hot is not None:
            ids = ids.union(hot.select("id"))
        ids = self.scratch.save(ids.distinct())
        others = self.copies.select(F.col("rep").alias("id"), F.col("id").alias("copy")).where("id != copy")
        return ids.union(others.join(self._hint(ids, ids.count(), 8), "id", "left_semi").select(F.col("copy").alias("id"))).distinct()

    def spans(self) -> DataFrame:
        """(id, start, end): maximal stretches of each record that are covered by shared spans."""
        runs = self.runs(self.pairs)
        hot = self.hot_runs()
        if hot is not None:
            runs = runs.union(hot)
        own = runs.unionByName(self.copies.select("id", F.lit(0).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("end"))).distinct()
        ordered = "partition by id order by start, end rows between unbounded preceding and 1 preceding"
        marked = own.selectExpr("*", f"max(end) over ({ordered}) as before").selectExpr("*", "case when before >= start then 0 else 1 end as opens")
        grouped = marked.selectExpr("*", "sum(opens) over (partition by id order by start, end rows unbounded preceding) as g")
        return grouped.groupBy("id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "start", "end")
