"""Fetched pages: decoding of their bytes, and a plain rule for their main text."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BLANK_ENDS, let, up_to_last, without_elements, without_tags

LEAST, FALLBACK = 50, 1


#: tried in this order where no encoding is named
TRIED = ("utf-8", "cp1252", "cp1251")


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes to text in the named encoding (UTF-8 if its name is unknown), bytes that do not fit becoming replacement characters. Where none
    is named the first of TRIED that reads all bytes counts, else UTF-8."""

    def one(b, e):
        if b is None:
            return None
        b = bytes(b)
        if e:
            try:
                return b.decode(e, "replace")
            except LookupError:
                return b.decode("utf-8", "replace")
        for guess in TRIED:
            with contextlib.suppress(UnicodeDecodeError):
                return b.decode(guess)
        return b.decode("utf-8", "replace")

    return pd.Series([one(b, e) for b, e in zip(data, encoding)])


def _dropper(name: str):
    return lambda x: without_elements(x, name)  # a second parameter, even with a default, would be taken for the place in the array


def paragraphs(html: Column) -> Column:
    """array of (text, linked): the page cut at block tags, with the share of each piece that lies inside links. Linear in the page."""
    block = r"(?i)<(?:/?(?:p|div|td|tr|table|li|ul|ol|h[1-6]|br|hr|section|article|aside|header|footer|nav|main|blockquote|center|body|html|head))\b"
    t = up_to_last(html, "-->", lambda h: F.regexp_replace(h, r"(?s)<!--.*?-->", ""))
    for name in ("script", "style", "title", "noscript"):
        t = let(t, _dropper(name))
    pieces = let(t, lambda x: F.split(without_tags(x, block, "\u0001"), "\u0001"))
    plain = lambda x: F.regexp_replace(without_tags(x, r"<[/!a-zA-Z]", ""), BLANK_ENDS, "")
    links = lambda x: F.aggregate(F.regexp_extract_all(F.regexp_extract(x, "(?s)^.*</a>", 0), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), F.lit(0), lambda a, y: a + F.length(y))
    got = F.transform(pieces, lambda x: let(plain(x), lambda t: F.struct(t.alias("text"), (links(x) / F.greatest(F.length(t), F.lit(1))).alias("linked"))))
    return F.filter(got, lambda p: p["text"] != "")


def main_text(html: Column) -> Column:
    """The dense paragraphs of a page (sentences, few links); all text if these hold less than LEAST characters."""

    def choose(ps: Column) -> Column:
        dense = F.filter(ps, lambda p: (p["linked"] < 0.3) & (F.length(p["text"]) >= 40) & p["text"].rlike(r"[.!?»”]$"))
        join = lambda a: F.array_join(F.transform(a, lambda p: p["text"]), "\n\n")
        return let(join(dense), lambda d: F.when(F.length(d) >= LEAST, d).otherwise(join(ps)))

    return let(paragraphs(html), choose)


def malformed(content: Column) -> Column:
    """Fewer than LEAST characters."""
    return F.coalesce(F.length(content) < LEAST, F.lit(True))
