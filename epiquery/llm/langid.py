"""Language of texts and of their paragraphs: multinomial naive Bayes over hashed character trigrams.

``fit`` takes a bounded sample of labelled texts; labels may be partly wrong, so each round relabels the sample's paragraphs
that clearly speak against theirs. The log-probability matrix (languages x 2^15, 1 MB whatever the data) goes to every task, and whole
batches are scored in numpy: one gather and one segmented sum for each language.

Defined results: a paragraph is a line with at least `min_words` words; null and empty texts and texts with fewer than
`min_text_words` words have no paragraphs; ties go to the first language in the model's order; repeated rows are labelled
alike; an empty sample gives a model without preference; a label that names no known language is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bounded_sample, spread
from . import textkit as K

#: code -> three-letter codes and English name
LANGUAGES = {
    "en": ("eng", "english"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"), "pt": ("por", "portuguese"),
    "de": ("deu", "ger", "german"), "it": ("ita", "italian"), "vi": ("vie", "vietnamese"), "ru": ("rus", "russian"),
}
CODES = list(LANGUAGES)
BITS = 15
#: characters of the longest text in the sample
LONGEST = 50_000
#: nats a character: what a paragraph needs against the language of its text, and a sample's paragraph against its label
MARGIN, RELABEL = 0.6, 0.5
_NAMES = {x: c for c, xs in LANGUAGES.items() for x in (c, *xs)}


def named_language(label: str | None) -> str | None:
    """The two-letter code a label names: code, three-letter code, English name or code with a region, in any case."""
    if label is None:
        return None
    x = label.strip().lower()
    return _NAMES.get(x) or (_NAMES.get(m[1]) if (m := re.fullmatch(r"([a-z]{2})(?:[-_][a-z0-9]+)+", x)) else None)


def _features(cp: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Trigram bucket at every code point; all that is not a letter or digit counts as a blank, every digit as the same."""
    x = np.where(inside, cp, np.uint32(32)).astype(np.uint32)
    x[(x >= 48) & (x < 58)] = 48
    with np.errstate(over="ignore"):
        h = x * np.uint32(0x9E3779B1)
        h[1:] ^= x[:-1] * np.uint32(0x85EBCA6B)
        h[2:] += x[:-2] * np.uint32(0xC2B2AE35)
        h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - BITS)).astype(np.intp)


def paragraphs(texts: list[str], min_words: int, min_text_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts' code points; of each paragraph: start, end, and the place of its text."""
    cp, starts = K.joined([t.lower() for t in texts])
    inside = K.is_alnum(cp)
    word = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    end = np.flatnonzero(cp == 10)
    begin = np.concatenate(([0], end[:-1] + 1))
    count = np.diff(np.searchsorted(word, np.append(begin, len(cp))))
    text = np.searchsorted(starts, begin, side="right") - 1
    total = np.diff(np.searchsorted(word, starts))
    ok = (count >= min_words) & (total[text] >= min_text_words)
    return _features(cp, inside), begin[ok], end[ok], text[ok]


def likelihoods(logp: np.ndarray, buckets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(languages, segments) log-likelihoods."""
    if not len(begin):
        return np.zeros((len(logp), 0), dtype=np.float32)
    cuts = np.empty(2 * len(begin), dtype=np.intp)
    cuts[0::2], cuts[1::2] = begin, end
    return np.stack([np.add.reduceat(row[buckets], cuts)[0::2] for row in logp])


def score(logp: np.ndarray, buckets: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment: the best language's index, and a confidence: its posterior, tempered by the root of the length.

    A segment that speaks against the language of its whole text by less than MARGIN a character (a line of names, say) is
    read in the language of the text.
    """
    total = likelihoods(logp, buckets, begin, end)
    if not len(begin):
        return np.zeros(0, dtype=int), np.zeros(0)
    best, at = total.argmax(axis=0), np.arange(len(begin))
    whole = np.stack([np.bincount(text, weights=row) for row in total]).argmax(axis=0)[text]
    best = np.where(total[best, at] - total[whole, at] < MARGIN * (end - begin), whole, best)
    z = (total - total.max(axis=0)) / np.sqrt(np.maximum(end - begin, 1))
    return best, np.exp(z)[best, at] / np.exp(z).sum(axis=0)


def fit(texts: list[str], labels: list[str | None], rounds: int = 3, smoothing: float = 0.5) -> np.ndarray:
    """Log-probabilities (languages, buckets) from labelled texts."""
    use = [(t, CODES.index(c)) for t, lab in zip(texts, labels) if t and (c := named_language(lab))]
    uniform = np.full((len(CODES), 1 << BITS), -BITS * np.log(2), dtype=np.float32)
    if not use:
        return uniform
    b, begin, end, text = paragraphs([t for t, _ in use], 8, 0)
    lang = np.array([c for _, c in use])[text]
    for _ in range(rounds):
        owner = np.full(len(b), -1)
        for s, e, c in zip(begin, end, lang):
            owner[s:e] = c
        ok = owner >= 0
        counts = np.bincount(owner[ok] * (1 << BITS) + b[ok], minlength=len(CODES) << BITS).reshape(len(CODES), -1) + smoothing
        logp = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        total = likelihoods(logp, b, begin, end)
        best, at = total.argmax(axis=0), np.arange(len(begin))
        lang = np.where(total[best, at] - total[lang, at] > RELABEL * (end - begin), best, lang)
    return logp


def labelled_sample(df: DataFrame, key: Column, text: Column, label: Column, rows: int = 4000) -> tuple[list[str], list[str]]:
    """At most `rows` labelled texts for fit(), none longer than LONGEST, spread evenly by the hash of a key; the bounds hold at every size of the data."""
    named = F.lower(F.trim(label)).rlike("^([a-z]{2}([-_][a-z0-9]+)*|[a-z]{3}|[a-z]{4,})$") & ~F.lower(label).isin("und", "xx")
    got = bounded_sample(df.where(named), key, rows).where(F.length(text) <= LONGEST).select("__k", text.alias("t"), label.alias("l")).collect()
    got.sort(key=lambda r: r["__k"])
    return [r.t for r in got], [r.l for r in got]


def label_paragraphs(df: DataFrame, logp: np.ndarray, id_col: Column, fields: dict[str, Column], min_words: int = 8, min_text_words: int = 0) -> DataFrame:
    """(id, field, paragraph, lang, confidence): every paragraph of the given text columns; paragraph counts from 0."""

    names = list(fields)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, field, text, lang, sure in _scored(batches, logp, names, min_words, min_text_words):
            first = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, dtype=bool)
            n = np.arange(len(text)) - np.maximum.accumulate(np.where(first, np.arange(len(text)), 0)) if len(text) else text
            yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in text], pa.int64()), pa.array([field] * len(text), pa.string()), pa.array(n, pa.int64()), pa.array([CODES[c] for c in lang], pa.string()), pa.array(sure, pa.float64())], names=["id", "field", "paragraph", "lang", "confidence"])

    rows = df.select(id_col.cast("bigint").alias("id"), *[c.alias(f) for f, c in fields.items()])
    return spread(rows).mapInArrow(label, "id bigint, field string, paragraph bigint, lang string, confidence double")


def _scored(batches: Iterator[pa.RecordBatch], logp: np.ndarray, fields: list[str], min_words: int, min_text_words: int) -> Iterator[tuple]:
    for batch in batches:
        ids = K.columns(batch, "id")[0]
        for field in fields:
            for rows, texts in K.chunks(ids, K.columns(batch, field)[0], 1 << 19):
                b, begin, end, text = paragraphs(texts, min_words, min_text_words)
                lang, sure = score(logp, b, begin, end, text)
                yield rows, field, text, lang, sure


def wrong_labels(df: DataFrame, logp: np.ndarray, id_col: Column, fields: dict[str, tuple[Column, Column]], min_words: int = 8, min_text_words: int = 20) -> DataFrame:
    """(id, field, lang): for each text whose paragraphs are not all in the one language its label names, the languages found.

    fields: name -> (text, label). One pass over the rows, no shuffle.
    """
    names = list(fields)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *labels = K.columns(batch, "id", *[f"{f}_label" for f in names])
            for field, labs in zip(names, labels):
                out = []
                for rows, texts in K.chunks(list(zip(ids, labs)), K.columns(batch, field)[0], 1 << 19):
                    b, begin, end, text = paragraphs(texts, min_words, min_text_words)
                    lang, _ = score(logp, b, begin, end, text)
                    seen: dict[int, set[int]] = {}
                    for t, c in zip(text.tolist(), lang.tolist()):
                        seen.setdefault(t, set()).add(c)
                    for t, cs in seen.items():
                        i, lab = rows[t]
                        if {CODES[c] for c in cs} != {named_language(lab)}:
                            out += [(i, field, CODES[c]) for c in sorted(cs)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["id", "field", "lang"])

    cols = [c.alias(n) for f, (t, lab) in fields.items() for n, c in ((f, t), (f"{f}_label", lab))]
    return spread(df.select(id_col.cast("bigint").alias("id"), *cols)).mapInArrow(found, "id bigint, field string, lang string")
