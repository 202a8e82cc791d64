"""Text garbled by wrong decoding: found and restored by a best-first search over encode, decode and unescape operations.

A page is read word by word (words are what ASCII white space and markup leave between them). A word whose characters are
implausible starts a search: its states are texts, hashed once visited; its steps undo an escape, or take the text's bytes in
one encoding and read them in another; its order is the plausibility cost of the text plus the cost of the steps so far. The
cheapest text reached is the restored one, and the word counts as garbled if that is better by at least GAIN and needed a
decoding step. A garbled word that the first, short search leaves is searched on at length; what that leaves too at its bound is
counted as given up. Replacement characters, question marks inside a word and left-over control characters are garbled
although nothing restores them. Words are searched once for each task (bounded cache).

Defined results: null and empty texts hold nothing garbled; a text of any length is read whole, in one pass; equal words give
equal results, ties between restorations go to the one reached with fewer steps, then to the smaller text.
"""

from __future__ import annotations

import functools
import heapq
import html as htmllib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..storage import spread
from . import textkit as K

#: gain at which a restoration counts, cost at which a word is garbled without one, most expansions of a first search and of the second
#: for garbled words that the first leaves, most steps, and the length above which a word is searched in pieces, cut after ASCII characters
GAIN, CERTAIN, POPS, MORE_POPS, DEPTH, LONG = 2.0, 7.0, 40, 4000, 4, 2048

SINGLE = ("cp1252", "latin-1", "cp1251", "koi8-r", "mac_roman", "cp437", "cp1250", "iso8859-2", "mac_cyrillic", "cp866", "cp850")
READ_AS = ("cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp1250", "cp437")

_ACCENTED = set("áàâãäåæçéèêëíìîïñóòôõöøúùûüýÿœßăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ")
_COMMON = set("áàâãäçéèêíïñóôõöúùûüß") | set("ăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹìòýî")
_OPEN, _CLOSE, _PLAIN = set("“«„‘¿¡"), set("”»’"), set("–—…·•©°№€")
# Per cent of the letters of Russian text.
_RUSSIAN = """о 10.97 е 8.45 а 8.01 и 7.35 н 6.70 т 6.26 с 5.47 р 4.73 в 4.54 л 4.40 к 3.49 м 3.21 д 2.98 п 2.81 у 2.62 я 2.01 ы 1.90
ь 1.74 г 1.70 з 1.65 б 1.59 ч 1.44 й 1.21 х 0.97 ж 0.94 ш 0.73 ю 0.64 ц 0.48 щ 0.36 э 0.32 ф 0.26 ё 0.60 ъ 0.20""".split()
_CYRILLIC = {c: max(0.0, -math.log2(float(p) / 100) - 4.6) * 0.4 for c, p in zip(_RUSSIAN[::2], _RUSSIAN[1::2])}

#: a word is what blanks and markup leave between them; one that holds SUSPECT is looked at whole, in others only letters cut by a "?"
_WORD = re.compile(r"""[^ \t\r\n\f\v<>"]+""")
_SUSPECT = re.compile(r"""[^\x00-\x7f]|&#?[A-Za-z0-9]{2,8};|\\u[0-9a-fA-F]{4}""")
_CUT = re.compile(r"(?<![A-Za-z/=&?.%-])[A-Za-z]+\?[a-z]+(?![=&/A-Za-z])")
_JSON = re.compile(r"\\u([0-9a-fA-F]{4})")
_LOST = re.compile(r"[a-zA-ZÀ-ɏẠ-ỹ]\?[a-zß-ÿ]")


def cost(text: str) -> float:
    """How implausible the characters of a word are; 0 for plain ASCII."""
    if text.isascii() and "?" not in text:
        return 0.0
    total, before, lower, run = 0.0, "", any(c.islower() for c in text), 0
    for n, c in enumerate(text):
        o = ord(c)
        if o < 128:
            run = 0
            if before >= "Ѐ" and before <= "ӿ" and c.isalpha():
                total += 3
        elif c == "�":
            total += 6
        elif o < 160:
            total += 5
        elif 0x400 <= o <= 0x4FF:
            low = c.lower()
            total += _CYRILLIC.get(low, 4.0)
            hard = low not in "аеёиоуыэюяьъй"
            run = (run + 1 if run > 0 else 1) if hard else (run - 1 if run < 0 else -1)
            total += 1.0 if run > 3 else 0.7 if run < -2 else 0.0
            if c != low:
                total += 2.0 if lower and before.isalpha() else 0.3
            if before.isalpha() and before < "Ѐ":
                total += 3
        elif c.isalpha() and c not in "ªºµ":
            low = c.lower()
            run = run + 1 if before.isalpha() and ord(before) > 127 else 1
            total += 1.0 if run > 2 and low < "ă" else 0.0
            total += 0.3 if low in _COMMON else 1.0 if low in _ACCENTED else 4.0
            if c != low:
                total += 0.2
                if lower and before.isalpha():
                    total += 3 if before.islower() else 1
            if "Ѐ" <= before <= "ӿ":
                total += 3
        elif c in "²³" and before == "m":
            total += 0.5
        elif c in _OPEN:
            closing = c in "“‘" and not text[n + 1 : n + 2].isalnum()
            total += 2.5 if before.isalnum() and not closing else 0.3
        elif c in _CLOSE:
            after = text[n + 1 : n + 2]
            total += 0.3 if c == "’" and before.isalpha() or not after.isalnum() else 2.5
            if before and ord(before) > 127 and not before.isalpha() and before not in "”»…° ":
                total += 1
        elif c == "°":
            total += 0.3 if before.isdigit() or before in " n" else 2.5
        elif c == "©":
            total += 0.3 if not before.isalpha() else 3
        elif c in _PLAIN:
            total += 0.5 if not (before.isalpha() and ord(before) > 127 and c not in "…–—·") else 2
            if c == "€" and (before.isalpha() or text[n + 1 : n + 2].isalpha()):
                total += 2
        elif c == " ":
            total += 0.5
        else:
            total += 4
        before = c
    if "?" in text:
        total += 4 * len(_LOST.findall(text))
    return total


def _encode(text: str, encoding: str) -> bytes | None:
    """The bytes of a text in a single-byte encoding; bytes that encoding leaves undefined passed through as C1 controls."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 128 <= ord(c) < 160:
                return None
            out.append(ord(c))
    return bytes(out)


def _decode(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _steps(text: str, deep: bool) -> Iterator[tuple[str, float, bool]]:
    """(next text, cost of the step, whether it decodes): first the cheap steps, with deep those between one-byte encodings."""
    if not deep:
        if "&" in text:
            yield htmllib.unescape(text), 0.1, False
        if "\\u" in text:
            yield _JSON.sub(lambda m: chr(int(m[1], 16)), text).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), 0.1, False
        for lost in ("Ã", "Â"):
            if lost in text:
                again = re.sub(lost + r"(?=$|[ -@\[-`{-~])", lost + " ", text)
                yield again, 0.6, False
        for e in SINGLE:
            data = _encode(text, e)
            if data is not None and (got := _decode(data, "utf-8")) is not None:
                yield got, 0.4, True
        return
    for e in SINGLE:
        data = _encode(text, e)
        if data is None:
            continue
        for d in READ_AS:
            if d != e and (got := _decode(data, d)) is not None:
                yield got, 0.9, True


def search(word: str, pops: int = POPS, depth: int = DEPTH) -> tuple[str, float, bool, bool]:
    """(best text, what it is cheaper by, whether it was decoded anew, whether the search came to its end) of the cheapest reachable text.

    It ends when nothing that is left can be much cheaper; after `pops` expansions it is given up, which the caller reports."""
    start = cost(word)
    best = (start, 0, word, False)
    queue = [(start, 0, word, 0.0, False, False)]
    seen = {hash(word)}
    for _ in range(pops):
        if not queue:
            return best[2], start - best[0], best[3], True
        _, steps, text, spent, decoded, deep = heapq.heappop(queue)
        if best[0] <= 0.45 * max(1, best[1]) + 1.0 and deep:
            return best[2], start - best[0], best[3], True
        if not deep:
            heapq.heappush(queue, (cost(text) + spent + 0.9, steps, text, spent, decoded, True))
        for got, price, by_decoding in _steps(text, deep):
            if got == text or hash(got) in seen:
                continue
            seen.add(hash(got))
            if "\x00" in got or steps >= depth:
                continue
            paid, now = spent + price, cost(got)
            best = min(best, (now + paid, steps + 1, got, decoded or by_decoding))
            heapq.heappush(queue, (now + paid, steps + 1, got, paid, decoded or by_decoding, False))
    return best[2], start - best[0], best[3], not queue


@functools.lru_cache(maxsize=200_000)
def looked_up(word: str) -> tuple[bool, str, bool]:
    """(garbled, the word as it was where that can be had, whether its search was given up at the bound)."""
    plain = word
    if "&" in plain:
        plain = htmllib.unescape(plain)
    if "\\u" in plain:
        plain = _JSON.sub(lambda m: chr(int(m[1], 16)), plain)
    c = cost(plain)
    if c < GAIN:
        return False, word, False
    best, gain, decoded, ended = search(plain)
    if decoded and gain >= GAIN:
        return True, best, False
    lost = "�" in plain or any(0x80 <= ord(x) < 0xA0 for x in plain) or bool(_LOST.search(plain) and "/" not in plain and "=" not in plain)
    if not lost and c < CERTAIN + 0.5 * len(plain):
        return False, word, False
    if not ended:
        best, gain, decoded, ended = search(plain, MORE_POPS)
        if decoded and gain >= GAIN:
            return True, best, False
    return True, word, not ended


def restored(word: str) -> tuple[bool, str]:
    """(garbled, the word as it was where that can be had)."""
    return looked_up(word)[:2]


def suspects(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) of the pieces of a text that may be garbled, in order; every character is looked at a bounded number of times."""
    if text.isascii() and "&" not in text and "\\u" not in text:
        yield from (m.span() for m in _CUT.finditer(text))  # a piece has no blank, so cutting at blanks changes nothing
        return
    for m in _WORD.finditer(text):
        word = m[0]
        if not word.isascii() or ("&" in word or "\\u" in word) and _SUSPECT.search(word):
            yield from _cut(word, m.start())
        elif "?" in word:
            yield from ((m.start() + c.start(), m.start() + c.end()) for c in _CUT.finditer(word))


def _cut(word: str, at: int) -> Iterator[tuple[int, int]]:
    """A word's span, or those of its suspect pieces of at most LONG characters."""
    lo = 0
    while len(word) - lo > LONG:
        hi = lo + LONG
        while hi > lo + LONG // 2 and word[hi - 1] > "\x7f":
            hi -= 1
        if word[hi - 1] > "\x7f":
            hi = lo + LONG
        if _SUSPECT.search(word, lo, hi):
            yield at + lo, at + hi
        lo = hi
    if not lo or _SUSPECT.search(word, lo):
        yield at + lo, at + len(word)


def garbled_words(text: str) -> Iterator[str]:
    return (w for s, e in suspects(text) if restored(w := text[s:e])[0])


def is_garbled(text: str) -> bool:
    return any(True for _ in garbled_words(text))


def repair(text: str) -> str:
    """The text with each garbled word as it was, if that can be had."""
    out, at = [], 0
    for s, e in suspects(text):
        out += [text[at:s], restored(text[s:e])[1]]
        at = e
    return "".join([*out, text[at:]])


def garbled_rows(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """(id): the records with at least one garbled character sequence."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [i for i, t in zip(*K.columns(batch, "id", "text")) if is_garbled(t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])

    return _texts(df, id_col, text).mapInArrow(rows, "id bigint").distinct()


def repaired_rows(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """(id, n_garbled, n_restored, n_given_up, text) of the garbled records; given up: words whose search ended at its bound."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(*K.columns(batch, "id", "text")):
                bad = list(garbled_words(t))
                if bad:
                    out.append((i, len(bad), sum(restored(w)[1] != w for w in bad), sum(looked_up(w)[2] for w in bad), repair(t)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["id", "n_garbled", "n_restored", "n_given_up", "text"])

    return _texts(df, id_col, text).mapInArrow(rows, "id bigint, n_garbled int, n_restored int, n_given_up int, text string")


def _texts(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    # most texts are wholly ASCII; the JVM drops those that can hold neither a non-ASCII character nor an escape nor a lost one
    d = df.select(id_col.cast("bigint").alias("id"), text.alias("text"))
    return spread(d.where("id is not null and text is not null").where(d.text.rlike(r"[^\x00-\x7f]|&#?\w{2,8};|\\u[0-9a-fA-F]{4}|[A-Za-z]\?[a-z]")))
