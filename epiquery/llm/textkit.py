"""Vectorised text primitives in numpy: code points, words, rolling hashes. Cost is linear in the text, whole texts only."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each element."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@functools.cache
def alnum_table() -> np.ndarray:
    """True at every code point of the Unicode classes L and N."""
    t = np.zeros(0x110000, dtype=bool)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] in "LN":
            t[cp] = True
    return t


@functools.cache
def bmp_alnum() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x10000)), dtype=bool, count=0x10000)


@functools.cache
def mixed_codepoints() -> np.ndarray:
    """splitmix of every BMP code point; astral ones are mixed on the fly."""
    return splitmix(np.arange(0x10000))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _P, dtype=U64), np.full(n, _PINV, dtype=U64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def is_alnum(cp: np.ndarray) -> np.ndarray:
    out = bmp_alnum()[np.minimum(cp, 0xFFFF)]
    big = cp > 0xFFFF
    if big.any():
        out[big] = alnum_table()[cp[big]]
    return out


def mix(cp: np.ndarray) -> np.ndarray:
    out = mixed_codepoints()[np.minimum(cp, 0xFFFF)]
    big = cp > 0xFFFF
    if big.any():
        out[big] = splitmix(cp[big])
    return out


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums H with H[j] - H[i] the polynomial hash of values[i:j], scaled by the power of i. values: 64-bit, mixed."""
    with np.errstate(over="ignore"):
        up, _ = powers(len(values))
        out = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * up, out=out[1:], dtype=U64)
        return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of values[start:end]."""
    with np.errstate(over="ignore"):
        _, down = powers(len(prefix))
        return splitmix((prefix[end] - prefix[start]) * down[start])


def chunks(ids: list, texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Runs of records with about `most` characters together, nulls left out; a longer text is a run of its own."""
    a, b, n = [], [], 0
    for i, t in zip(ids, texts):
        if t is None:
            continue
        if b and n + len(t) > most:
            yield a, b
            a, b, n = [], [], 0
        a.append(i)
        b.append(t)
        n += len(t)
    if b:
        yield a, b


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a line feed between them, and where each text starts (one more entry at the end)."""
    cp = codepoints("\n".join(texts) + "\n")
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cp, starts


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: word hashes, word starts and ends (in the joined code points), first word of each text (+ end)."""
    cp, starts = joined([t.lower() for t in texts])
    inside = is_alnum(cp)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    s, e = edge[0::2], edge[1::2]
    h = range_hash(prefix_hash(mix(cp)), s, e)
    return h, s, e, np.searchsorted(s, starts)


def run_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words inside a text, and for each text the position of its first run (+ end)."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    begin = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=begin[1:])
    pos = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    acc = np.zeros(len(pos), dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * U64(_P) + h[pos + j]
    return splitmix(acc), begin


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
