"""Filling containers of fixed capacity with texts measured in tokens: bulk-synchronous best-fit.

Texts are range-sorted by size, and so are the gaps of the containers. A sweep matches the texts of one size with their
successor gaps (the smallest that hold them), all at once; the rank of a text among those of its size decides which gap it gets,
the gaps are updated, and the sweep goes on with the next smaller size. Texts of one size are interchangeable, and so are gaps
of one size, so the sweeps run on run-length coded sizes: at most `capacity` sizes and runs of containers, whatever the number of
texts. Only that table of sizes is gathered; the texts themselves get their container by rank, in parallel.

The sweeps need all sizes and gaps in one place, which their run-length code makes a table of bounded size; as rounds of joins over saved
tables they took thirty times as long and 0.7 % more containers (see the README). The result equals best-fit decreasing. A text larger than the capacity is cut into full containers and a rest, which is packed
like any other text; no other text is split.

Defined results: null, empty and token-less texts go nowhere; repeated rows are packed each; equal sizes are ranked by id, then by
piece; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, small_enough, spread
from . import textkit as K

TOKENIZERS = "/opt/tokenizers"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048


@functools.cache
def encoder(path: str, vocabulary: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(f"{path}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: Column, text: Column, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, tokens): the size of each text that has any token."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizers)
        for batch in batches:
            got = [(i, len(e.encode_ordinary(t))) for i, t in zip(*K.columns(batch, "id", "text"))]
            got = [x for x in got if x[1]]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["id", "tokens"])

    return spread(df.select(id_col.cast("bigint").alias("id"), text.alias("text")).where("id is not null and text <> ''")).mapInArrow(rows, "id bigint, tokens bigint")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, start, tokens): each text, those above the capacity cut into full pieces and a rest."""
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    d = sizes.select("id", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return d.select("id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("all") - start).alias("tokens"))


def sweeps(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on run-length coded sizes: (size, first rank, past last rank, first container, texts a container)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, past last)
    order: list[int] = []  # gaps in use, ascending
    out, opened = [], 0

    def put(gap: int, lo: int, hi: int) -> None:
        if gap and hi > lo:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((lo, hi))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                lo, hi = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, lo = capacity, opened
                hi = opened = opened + -(-left // (capacity // size))
            each = gap // size
            full = min(hi - lo, left // each)
            if full:
                out.append((size, rank, rank + full * each, lo, each))
                put(gap - each * size, lo, lo + full)
                rank, left, lo = rank + full * each, left - full * each, lo + full
            if lo < hi and 0 < left < each:
                out.append((size, rank, rank + left, lo, left))
                put(gap - left * size, lo, lo + 1)
                rank, left, lo = rank + left, 0, lo + 1
            put(gap, lo, hi)
    return out


def ranked(items: DataFrame, scratch: Scratch) -> DataFrame:
    """items with `rank`, the place among those of the same size by (id, piece); no size is ever gathered in one task."""
    n = max(2, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = items.repartitionByRange(n, "tokens", "id", "piece").withColumn("part", F.spark_partition_id())
    ordered = scratch.save(ordered)
    per = ordered.groupBy("tokens", "part").agg(F.count("*").alias("n"))
    before = per.selectExpr("tokens", "part", "sum(n) over (partition by tokens order by part) - n as before")
    local = ordered.selectExpr("*", "row_number() over (partition by part, tokens order by id, piece, start) - 1 as r")
    hint = F.broadcast if small_enough(per.count(), 48) else (lambda x: x)
    return local.join(hint(before), ["tokens", "part"]).selectExpr("id", "piece", "start", "tokens", "r + before as rank")


def packed(sizes: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, tokens, container) of sizes (id, tokens)."""
    items = scratch.save(pieces(sizes, capacity))
    histogram = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = sweeps(histogram, capacity)
    spark = items.sparkSession
    schema = "tokens bigint, lo bigint, hi bigint, first bigint, each bigint"
    table = spark.createDataFrame(pa.table({k: pa.array(np.array(v, dtype=np.int64)) for k, v in zip(("tokens", "lo", "hi", "first", "each"), zip(*runs))})) if runs else spark.createDataFrame([], schema)
    table = F.broadcast(table) if small_enough(len(runs), 48) else table
    met = ranked(items, scratch).alias("i").join(table.alias("t"), F.expr("i.tokens = t.tokens and i.rank >= t.lo and i.rank < t.hi"))
    return met.selectExpr("i.id", "i.piece", "i.start", "i.tokens", "t.first + (i.rank - t.lo) div t.each as container")
