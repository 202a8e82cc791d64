"""Spans over texts: keyword, date and count annotations, overlap rules, grouping of offsets. Ends are exclusive."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import small_enough
from . import features as FE

MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"[0-9]{{1,2}} (?:{MONTH})(?: [12][0-9]{{3}})?|(?:{MONTH}) [0-9]{{1,2}}(?:, [12][0-9]{{3}})?"
#: hits that a task holds at once, and texts; bits of a lexicon's filter at most (32 MB), and for each keyword
ROWS, TEXTS, MOST_BITS, BITS_EACH = 65_536, 500, 1 << 28, 64
COUNT = r"(?:[Aa] total of |[Cc]umulative )?[0-9]{1,7} (?:suspected cases?|samples positive|deaths?|patients?|new admissions|contacts|cases?)"


def pattern_spans(docs: DataFrame, doc: str, text: Column, pattern: str) -> DataFrame:
    """(doc, start, end, label): all matches of a pattern, left to right, in one linear pass over each text."""
    found = re.compile(pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, m.start(), m.end(), m[0]) for i, t in zip(*(batch.column(c).to_pylist() for c in (0, 1))) for m in found.finditer(t)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=[doc, "start", "end", "label"])

    return docs.select(doc, text.alias("t")).where("t is not null").mapInArrow(rows, f"{doc} bigint, start int, end int, label string")


def keyword_spans(docs: DataFrame, doc: str, text: Column, keywords: DataFrame, optimal: bool = False) -> DataFrame:
    """(doc, type, start, end, label) of the keywords (type, keyword, case_sensitive) of up to five tokens in each text.

    The label is the keyword as written for case-sensitive ones, else in lower case. With optimal only the spans of optimal_spans, chosen in
    the same pass. A lexicon of a checked size goes to the tasks, which read each text once; of a larger one a bitmap of its keywords' hashes
    goes there, and only the runs that pass it are joined with the keywords."""
    k = keywords.select("type", "keyword", "case_sensitive", X.tokens(F.col("keyword")).alias("kt"), X.tokens(F.col("keyword"), lower=False).alias("kraw"))
    k = k.where("size(kt) between 1 and 5").select("type", F.array_join("kt", " ").alias("k"), F.array_join("kraw", " ").alias("kraw"), "case_sensitive", F.col("kt")[0].alias("first"), F.size("kt").alias("n")).distinct()
    size = k.count()
    if small_enough(size, 400):
        index: dict[str, list[tuple]] = {}
        for r in k.collect():
            index.setdefault(r["first"], []).append((r["n"], r["k"].split(" "), r["kraw"].split(" ") if r["case_sensitive"] else None, r["type"], r["kraw"] if r["case_sensitive"] else r["k"]))
        return docs.select(doc, text.alias("t")).where("t is not null").mapInArrow(_found(index, doc, optimal), f"{doc} bigint, type string, start int, end int, label string")
    bits = min(MOST_BITS, 1 << max(15, (size * BITS_EACH - 1).bit_length()))
    t = docs.select(doc, text.alias("t")).where("t is not null").mapInArrow(_likely(_bitmap(k, bits), bits, doc), f"{doc} bigint, k string, run string, start int, end int")
    met = t.join(k.select("type", "k", "kraw", "case_sensitive"), "k").where("not case_sensitive or run = kraw")
    got = met.select(doc, "type", "start", "end", F.when(F.col("case_sensitive"), F.col("kraw")).otherwise(F.col("k")).alias("label"))
    return optimal_spans(got, doc) if optimal else got.distinct()


def _bitmap(k: DataFrame, bits: int) -> bytes:
    """A bit for the hash of each keyword k, and of each first token after a blank; at most bits / 8 bytes whatever the lexicon's size."""
    h = k.select(F.explode(F.array("k", F.concat(F.lit(" "), "first"))).alias("x")).select((F.crc32(F.col("x").cast("binary")) % bits + 1).alias("h"))
    out = bytearray(bits // 8)
    for r in h.groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(out)


def _likely(bitmap: bytes, bits: int, doc: str):
    """(doc, k, run, start, end): runs of up to five tokens whose hash is in the bitmap, in lower case and as written."""
    token, last = re.compile(FE.TOKEN), bits - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def there(x: str) -> int:
            h = crc32(x.encode()) & last
            return bitmap[h >> 3] >> (h & 7) & 1

        class Begins(dict):
            def __missing__(self, w: str) -> int:
                self[w] = found = there(" " + w)
                return found

        def hits(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=[doc, "k", "run", "start", "end"])

        for batch in batches:
            out: list[tuple] = []
            begins = Begins()
            for i, t in (x for b in range(0, batch.num_rows, TEXTS) for x in zip(*(batch.column(c).slice(b, TEXTS).to_pylist() for c in (0, 1)))):
                at = list(token.finditer(t))
                low = [x[0].lower() for x in at]
                for p in [p for p, w in enumerate(low) if begins[w]]:
                    for e in range(p + 1, min(p + 5, len(at)) + 1):
                        if there(k := " ".join(low[p:e])):
                            out.append((i, k, " ".join([x[0] for x in at[p:e]]), at[p].start(), at[e - 1].end()))
                    if len(out) >= ROWS:
                        yield hits(out)
                        out = []
            if out:
                yield hits(out)

    return rows


def _found(index: dict[str, list[tuple]], doc: str, optimal: bool):
    token = re.compile(FE.TOKEN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                at = [(m[0], m.start(), m.end()) for m in token.finditer(t)]
                low, spans = [x[0].lower() for x in at], set()
                for p in [p for p, w in enumerate(low) if w in index]:
                    for n, k, raw, kind, label in index[low[p]]:
                        if low[p : p + n] == k and (raw is None or [x[0] for x in at[p : p + n]] == raw):
                            spans.add((kind, at[p][1], at[p + n - 1][2], label))
                if optimal:
                    by: dict[str, list] = {}
                    for kind, *span in sorted(spans):
                        by.setdefault(kind, []).append(tuple(span))
                    spans = {(kind, *own[j]) for kind, own in by.items() for j in best_cover(own)}
                out += [(i, *x) for x in spans]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=[doc, "type", "start", "end", "label"])

    return rows


def without_overlaps(spans: DataFrame, others: DataFrame, doc: str) -> DataFrame:
    """Spans that overlap none of the others in the same text.

    Both are bucketed by blocks of 256 characters, so the join is an equi-join whatever a text's length."""
    block = lambda d: d.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / 256), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / 256))))
    o = block(others.select(doc, "start", "end")).withColumnsRenamed({"start": "os", "end": "oe"})
    hit = block(spans.select(doc, "start", "end").distinct()).join(o, [doc, "__b"]).where("start < oe and os < end").select(doc, "start", "end").distinct()
    return spans.join(hit, [doc, "start", "end"], "left_anti")


def grouped_offsets(spans: DataFrame, doc: str, *by: str) -> DataFrame:
    """(doc, by..., offsets): sorted "start-end" of the spans of each group."""
    one = F.struct(F.col("start"), F.col("end"))
    g = spans.groupBy(doc, *by).agg(F.array_sort(F.collect_set(one)).alias("o"))
    return g.select(doc, *by, F.array_join(F.transform("o", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ").alias("offsets"))


def best_cover(spans: list[tuple]) -> list[int]:
    """Places of the non-overlapping spans (start, end, label) that cover most characters: weighted interval scheduling.

    Ties prefer the earlier end, then the longer span, then the smaller label; an empty span covers nothing."""
    order = sorted(range(len(spans)), key=lambda j: (spans[j][1], spans[j][0], spans[j][2]))
    kept: list[int] = []
    for j in order:
        if not kept or spans[kept[-1]][:2] != spans[j][:2]:
            kept.append(j)
    ends = [spans[j][1] for j in kept]
    before = [bisect.bisect_right(ends, spans[j][0]) for j in kept]
    total = [0] * (len(kept) + 1)
    for i, j in enumerate(kept):
        total[i + 1] = max(total[i], total[before[i]] + spans[j][1] - spans[j][0])
    out, i = [], len(kept)
    while i:
        if total[i] == total[i - 1]:
            i -= 1
        else:
            out.append(kept[i - 1])
            i = before[i - 1]
    return out[::-1]


def optimal_spans(spans: DataFrame, doc: str) -> DataFrame:
    """(doc, type, start, end, label): for each text and type the spans of best_cover; repeated spans count once.

    The spans come to the tasks in the order of the texts, so a task holds a batch of spans and those of one text, not those of a batch of texts."""
    names = [doc, "type", "start", "end", "label"]
    s = spans.select(doc, "type", F.col("start").cast("int"), F.col("end").cast("int"), "label").repartition(doc).sortWithinPartitions(doc)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, by = None, {}

        def chosen() -> list[tuple]:
            return [(at, kind, *own[j]) for kind, own in ((k, list(v)) for k, v in by.items()) for j in best_cover(own)]

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=names)

        for batch in batches:
            out: list[tuple] = []
            for i, kind, *span in zip(*(c.to_pylist() for c in batch.columns)):
                if i != at:
                    out += chosen()
                    at, by = i, {}
                by.setdefault(kind, set()).add(tuple(span))
            if out:
                yield sent(out)
        if out := chosen():
            yield sent(out)

    return s.mapInArrow(rows, f"{doc} bigint, type string, start int, end int, label string")


def date_features(spans: DataFrame, doc: str, years: DataFrame) -> DataFrame:
    """(doc, type, start, end, label, begin, stop) of date spans: the day named as the range [begin, stop). A date without a year is of the
    year of its text, from years (doc, year); without that, or if there is no such day, the range is null."""
    own = F.regexp_extract("label", r"([12][0-9]{3})$", 1)
    day = F.regexp_extract(F.regexp_replace("label", r"[12][0-9]{3}$", ""), r"([0-9]{1,2})", 1)
    month = F.regexp_extract("label", f"({MONTH})", 1)
    d = spans.join(years.select(doc, "year"), doc, "left")
    text = F.concat_ws(" ", day, month, F.when(own != "", own).otherwise(F.col("year").cast("string")))
    begin = F.when((own != "") | F.col("year").isNotNull(), F.try_to_date(text, "d MMMM yyyy"))
    return d.select(doc, F.lit("datetime").alias("type"), "start", "end", "label", begin.alias("begin"), F.date_add(begin, 1).alias("stop"))


def count_features(spans: DataFrame, doc: str) -> DataFrame:
    """(doc, type, start, end, label, value, cumulative): each count, and once more as caseCount where its noun is "case". A count after
    "a total of" or "cumulative" is cumulative."""
    value = F.regexp_extract("label", r"([0-9]+)", 1).cast("bigint")
    types = F.when(F.col("label").contains("case"), F.array(F.lit("count"), F.lit("caseCount"))).otherwise(F.array(F.lit("count")))
    return spans.select(doc, F.explode(types).alias("type"), "start", "end", "label", value.alias("value"), (~F.col("label").rlike("^[0-9]")).alias("cumulative"))


def incidents(counts: DataFrame, dates: DataFrame, places: DataFrame, diseases: DataFrame, doc: str) -> DataFrame:
    """(doc, start, end, type, value, begin, stop, place, disease): each count of cases or deaths with the date, place and disease that
    stand nearest to it in its text; of two as near, the earlier. What a text doesn't have is null.

    dates: (doc, start, begin, stop); places and diseases: (doc, start, label). Only spans of one text ever meet."""
    kind = F.when(F.col("label").contains("death"), "deathCount").otherwise("caseCount")
    c = counts.where(F.col("label").rlike("case|death")).select(doc, "start", "end", kind.alias("type"), "value").distinct()
    out = c
    for other, columns in ((dates, {"begin": "begin", "stop": "stop"}), (places, {"label": "place"}), (diseases, {"label": "disease"})):
        o = other.select(doc, F.col("start").alias("at"), *[F.col(k).alias(v) for k, v in columns.items()])
        near = c.select(doc, "start", "end").join(o, doc).groupBy(doc, "start", "end").agg(F.min(F.struct(F.abs(F.col("at") - F.col("start")).alias("far"), "at", *columns.values())).alias("n"))
        out = out.join(near.select(doc, "start", "end", *[F.col(f"n.{v}").alias(v) for v in columns.values()]), [doc, "start", "end"], "left")
    return out


def location_features(spans: DataFrame, gazetteer: DataFrame, doc: str) -> DataFrame:
    """(doc, geonameid, name, offsets): spans whose label is a name in the gazetteer (geonameid, name), grouped by place."""
    g = gazetteer.select("geonameid", "name", F.lower("name").alias("k")).distinct()
    met = spans.withColumn("k", F.lower("label")).join(g, "k").select(doc, "geonameid", "name", "start", "end")
    return grouped_offsets(met, doc, "geonameid", "name")
