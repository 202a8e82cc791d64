"""Evaluation texts that leak into training texts, found by canonical templates.

Every text becomes words, and every word a template slot: digits are <number>, units <unit>, and all words outside a vocabulary <name>;
other words stand for themselves. The vocabulary holds frequent evaluation words that are not names, a name being what is mostly
written with a capital. Typing depends on the lower-cased word alone, so both sides always agree; a smaller vocabulary makes templates
coarser and never loses a document. Windows of templates are winnowed (any run of `least` equal templates keeps a common window) and
hash-joined, document with evaluation side. Then the slots are checked, first in the window, then along the whole run:

* mode "same": no slot may differ. This finds every document with at least `least` consecutive words of an item.
* mode "consistent": fillings may differ, but each must stand for one other filling throughout the run, and at least one differs:
  re-parameterised items. In the window both sides must show the same pattern of equal and different fillings.

A template of more than HOT evaluation windows (names only, stock phrases) is split by what its slots must agree in, on both sides, so it
makes no more pairs than agree. The evaluation side is broadcast only if it fits the checked bound; otherwise both sides are shuffled on
the key, and a Bloom filter of the evaluation templates keeps the windows of the documents that can't meet any out of the shuffle.

Defined results: null and short texts match nothing; words are maximal runs of letters and digits of the lower-cased text;
repeated ids are one record; an empty table on either side gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, small_enough, spread
from . import textkit as K
from .sharedspans import long_runs, winnow

UNITS = """mm cm m km metre metres meter meters kilometre kilometres mg g kg ml l litre litres percent prozent pour por per cento
second seconds minute minutes hour hours day days week weeks month months year years jours heures días horas dias ore giorni tagen stunden
doses dosen dosi vials beds cases deaths euros dollars usd eur c f""".split()
#: words of the vocabulary, evaluation windows above which a template is split, most bits of the Bloom filter
VOCABULARY, HOT, BITS = 1 << 16, 64, 1 << 28
NUMBER, UNIT, NAME = (K.splitmix(np.array([x]))[0] for x in (1, 2, 3))
WINDOW = 12


def _word_hashes(words: list[str]) -> np.ndarray:
    return K.words([" ".join(words)])[0] if words else np.zeros(0, dtype=K.U64)


def vocabulary(items: DataFrame, text: Column, size: int = VOCABULARY) -> list[str]:
    """The `size` words that stand in most evaluation texts, in two at least, and are mostly written without a capital; counted over all of them."""
    w = items.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    g = w.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"), F.avg(F.col("w").rlike(r"^\p{Lu}").cast("int")).alias("capital"))
    top = g.where("n > 1 and capital <= 0.5").orderBy(F.desc("n"), "w").limit(size)
    return [r.w for r in top.collect()]


class Bloom:
    """A set of 64-bit keys in a bounded number of bits; it may hold others too, never fewer."""

    def __init__(self, keys: int):
        self.bits = min(BITS, 1 << max(16, int(16 * keys).bit_length()))
        self.data = np.zeros(self.bits >> 3, dtype=np.uint8)

    def _places(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for n in range(4):
            yield (K.splitmix(x + K.U64(n * 0x51ED27)) & K.U64(self.bits - 1)).astype(np.int64)

    def add(self, x: np.ndarray) -> None:
        for at in self._places(x):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), dtype=bool)
        for at in self._places(x):
            ok &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return ok


def bloom_of(windows: DataFrame, rows: int) -> Bloom:
    """Of the templates of a table; made in four tasks, each of which returns its bits."""
    empty = Bloom(rows)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(rows)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).view(K.U64))
        yield pa.RecordBatch.from_arrays([pa.array([own.data.tobytes()], pa.binary())], names=["bits"])

    for r in windows.select("template").coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        empty.data |= np.frombuffer(r.bits, dtype=np.uint8)
    return empty


class Templates:
    """Template and slot hashes of batches of texts."""

    def __init__(self, vocab: list[str]):
        self.words = np.unique(_word_hashes(vocab))
        self.units = np.unique(_word_hashes(UNITS))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, template hashes (typed slots replaced), first word of each text (+ end)."""
        lower = [t.lower() for t in texts]
        h, s, e, first = K.words(lower)
        cp, _ = K.joined(lower)
        digit = np.zeros(len(cp) + 1, dtype=np.int32)
        np.cumsum((cp >= 48) & (cp <= 57), out=digit[1:])
        t = h.copy()
        t[~_member(h, self.words)] = NAME
        t[_member(h, self.units)] = UNIT
        t[digit[e] > digit[s]] = NUMBER
        return h, t, first


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def patterns(fill: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of which fillings of the windows at `at` are equal to which: each as the distance to its last place in the window, 0 if there is none."""
    n = len(fill)
    order = np.lexsort((np.arange(n), fill))
    back = np.zeros(n, dtype=np.int64)
    same = fill[order[1:]] == fill[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    back[fill == 0] = 0
    acc = np.zeros(len(at), dtype=K.U64)
    with np.errstate(over="ignore"):
        for j in range(window):
            d = back[at + j]
            acc = acc * K.U64(0x9E3779B97F4A7C15) + np.where(d <= j, d, 0).astype(K.U64) + K.U64(1)
    return K.splitmix(acc)


def _window_rows(model: Templates, least: int, window: int, same: bool, hot: np.ndarray | None = None, bloom: Bloom | None = None):
    """Rows (id, text) -> (id, pos, template, part, slots): the winnowed windows. slots: what the slots of the window must agree in;
    part: the same for hot templates, else 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in K.chunks(*K.columns(batch, "id", "text"), 1 << 19):
                h, t, first = model.of(texts)
                n = len(h) - window + 1
                if n <= 0:
                    continue
                at = np.arange(n)
                tw = K.range_hash(K.prefix_hash(K.splitmix(t)), at, at + window)
                valid = np.zeros(n + 1, dtype=np.int32)
                begin, end = first[:-1], first[1:] - least + 1
                ok = end > begin
                np.add.at(valid, begin[ok], 1)
                np.add.at(valid, np.minimum(end[ok], n), -1)
                pos = winnow(K.splitmix(tw), np.cumsum(valid)[:n] > 0, least - window + 1)
                if bloom is not None:
                    pos = pos[bloom.holds(tw[pos])]
                if not len(pos):
                    continue
                fill = np.where(h == t, K.U64(0), h)
                slots = K.range_hash(K.prefix_hash(K.splitmix(fill)), pos, pos + window) if same else patterns(fill, pos, window)
                part = np.where(_member(tw[pos], hot), slots, K.U64(0)) if hot is not None and len(hot) else np.zeros_like(slots)
                text = np.searchsorted(first, pos, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[text]), pa.array((pos - first[text]).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (tw[pos], part, slots))], names=["id", "pos", "template", "part", "slots"])

    return rows


def _checked(model: Templates, least: int, same: bool):
    """Rows (a, b, shifts, ta, tb) -> (doc_id, item_id, words, changed): the longest run of equal templates whose slots agree."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, shifts, ta, tb in zip(*K.columns(batch, "a", "b", "shifts", "ta", "tb")):
                (x, tx, _), (y, ty, _) = model.of([ta]), model.of([tb])
                best = (0, 0)
                for d in set(shifts):
                    for s, e in long_runs(tx, ty, d, least):
                        if same:
                            best = max(best, *((v - u, 0) for u, v in long_runs(x[s:e], y[s - d : e - d], 0, least)), (0, 0))
                        else:
                            best = max(best, _consistency(x[s:e].tolist(), y[s - d : e - d].tolist(), least))
                if best[0]:
                    out.append((a, b, *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "words", "changed"])

    return rows


def _consistency(x: list, y: list, least: int) -> tuple[int, int]:
    """(words, changed slots) of the longest stretch in which fillings map one to one and some differ; (0, 0) if none is long enough."""
    best, start = (0, 0), 0
    while start < len(x):
        there, back, changed, i = {}, {}, 0, start
        while i < len(x) and there.setdefault(x[i], y[i]) == y[i] and back.setdefault(y[i], x[i]) == x[i]:
            changed += x[i] != y[i]
            i += 1
        if i - start >= least and changed:
            best = max(best, (i - start, changed))
        if i == len(x):
            break
        clash = i
        start = max(j for j in range(start, clash) if x[j] == x[clash] or y[j] == y[clash]) + 1
    return best


def _rows(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    return spread(df.select(id_col.cast("bigint").alias("id"), text.alias("text")).where("id is not null and text is not null"))


def leaked(docs: DataFrame, doc_id: Column, doc_text: Column, items: DataFrame, item_id: Column, item_text: Column, scratch: Scratch, least: int = 20, mode: str = "same", window: int | None = None) -> DataFrame:
    """(doc_id, item_id, words, changed): the documents that hold at least `least` consecutive words of an item, with `changed` slots
    filled otherwise (0 in mode "same")."""
    model = Templates(vocabulary(items, item_text))
    d, e = _rows(docs, doc_id, doc_text), _rows(items, item_id, item_text).dropDuplicates(["id"])
    same = mode == "same"
    window = min(least, window or (WINDOW if same else max(WINDOW, least - 8)))
    schema = "id bigint, pos int, template bigint, part bigint, slots bigint"
    every = scratch.save(e.mapInArrow(_window_rows(model, least, window, same), schema))
    many = every.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("template")  # at most one in HOT windows
    hot = np.sort(many.toPandas()["template"].to_numpy(dtype=np.int64).view(K.U64))
    marked = many.withColumn("is_hot", F.lit(True))
    ew = every.join(F.broadcast(marked) if small_enough(len(hot), 64) else marked, "template", "left").withColumn("part", F.when(F.col("is_hot"), F.col("slots")).otherwise(F.lit(0).cast("bigint")))
    ew = ew.select("template", "part", F.col("slots").alias("own"), F.col("id").alias("b"), F.col("pos").alias("pb"))
    n = every.count()
    small = small_enough(n, 96)
    dw = d.mapInArrow(_window_rows(model, least, window, same, hot, None if small else bloom_of(every, n)), schema).withColumnsRenamed({"id": "a", "pos": "pa"})
    met = dw.join(F.broadcast(ew) if small else ew, ["template", "part"]).where("slots = own").select("a", "b", (F.col("pa") - F.col("pb")).alias("shift"))
    pairs = scratch.save(met.distinct().groupBy("a", "b").agg(F.collect_list("shift").alias("shifts")))
    n = pairs.count()
    hint = F.broadcast if small_enough(n, 64) else (lambda x: x)
    ta = d.withColumnsRenamed({"id": "a", "text": "ta"}).join(hint(pairs.select("a").distinct()), "a", "left_semi").dropDuplicates(["a"])
    tb = e.withColumnsRenamed({"id": "b", "text": "tb"})
    size = e.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    both = pairs.join(ta, "a").join(F.broadcast(tb) if small_enough(size, 2) else tb, "b").select("a", "b", "shifts", "ta", "tb")
    return both.mapInArrow(_checked(model, least, same), "doc_id bigint, item_id bigint, words bigint, changed bigint")
