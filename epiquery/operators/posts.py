"""Structured parsing of mailing-list posts: subject line, tags, header fields, moderators' comments, sections, articles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timestamps as TS

# The grammar of subject lines and the patterns of tags and sections.
SUBJECT = r"^PRO(?:/(\w{1,3}))?(?:/(\w{1,3}))?> (.+?)(?: - (\w[\w\s]*?\w(?: \(\D[\D\s]*?\w\))?))?(?: \((\d{1,3})\))?(?:: (.*))?$"
OLD_SUBJECT = r"^PROMED: (.+)"
TAGS = {
    "announcement": r"(?i)announcement", "correction": r"(?i)corr\.|correction", "rfi": r"(?i)\bRFI\b|request for information",
    "summary": r"(?i)summary", "update": r"(?i)update",
}
UNDIAGNOSED = r"(?i)((unknown|unidentified) (illness|disease))|undiagnosed"
NOTICE = r"(?i)Visit ProMED-mail's web site at|Please support (the \d{4}\s)?ProMED-mail|Donate to ProMED-mail. Details available at|ProMED-mail makes every effort to verify the reports|PROMED-MAIL FREQUENTLY ASKED QUESTIONS|Become a ProMED-mail Premium Subscriber|A ProMED-mail post"
CONTENTS, VARIOUS = r"In this (update|post(ing)?)", r"Cases in various countries"
SECTION = r"(?m)^[*#]{3,}[ \t\r\f]*$"
COMMUNICATED = r"(?m)^--\n(?:Communicated by:\n)?\n*((?:.+\n)*.+$)?"


def _group(c: Column, pattern: str, n: int) -> Column:
    got = F.regexp_extract(c, pattern, n)
    return F.when(got != "", got)


def subject_fields(subject: Column, grammar: str = SUBJECT) -> dict[str, Column]:
    """ns1, ns2, description, region, thread_num, additional_info, is_malformed of a subject line."""
    new, old = subject.rlike(grammar), subject.rlike(OLD_SUBJECT)
    part = lambda n: F.when(new, _group(subject, grammar, n))
    description = F.when(new, _group(subject, grammar, 3)).when(old, _group(subject, OLD_SUBJECT, 1)).otherwise(subject)
    return {"ns1": part(1), "ns2": part(2), "description": description, "region": part(4), "thread_num": part(5).cast("bigint"), "additional_info": part(6), "is_malformed": ~(new | old)}


def subject_tags(subject: Column, description: Column) -> Column:
    """Sorted tags of a subject line."""
    tags = [F.when(subject.rlike(p), F.lit(t)) for t, p in TAGS.items()] + [F.when(description.rlike(UNDIAGNOSED), F.lit("undiagnosed"))]
    return F.array_sort(F.array_compact(F.array(*tags)))


def simplified(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("and")), F.lit(","), F.lit(""))


def subject_labels(posts: DataFrame, post: str, description: Column, labels: DataFrame, label: str, order: str) -> DataFrame:
    """(post, label, order): labels that stand as whole words in a post's description, in the order of the table.

    Both are simplified; words end as ASCII words do. Labels are found by their first word and then compared as written, case aside, so
    no label meets a post that lacks its first word. Labels that don't begin with an ASCII letter or digit are never found."""
    words = r"[A-Za-z0-9_]+"
    d = posts.select(post, F.lower(simplified(description)).alias("__s")).where("__s <> ''")
    w = d.select(post, "__s", F.explode(F.array_distinct(F.regexp_extract_all("__s", F.lit(words), F.lit(0)))).alias("__w"))
    name = F.lower(simplified(F.col(label)))
    k = labels.select(label, order, name.alias("__n"), F.regexp_extract(name, f"^{words}", 0).alias("__w")).where("__w <> ''")
    whole = F.expr(r"__s rlike concat('(?<![A-Za-z0-9_])\\Q', __n, '\\E', case when __n rlike '[A-Za-z0-9_]$' then '(?![A-Za-z0-9_])' else '(?=[A-Za-z0-9_])' end)")
    return w.join(k, "__w").where(F.contains("__s", "__n") & whole).select(post, label, order).distinct()


def header(text: Column, field: str) -> Column:
    """The rest of the line after "field: "."""
    return _group(text, rf"{field}:\s(.*)", 1)


def linked_reports(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d{8}\.\d+"), F.lit(0))


def links(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"http\S+[^(.\])>\s]"), F.lit(0))))


def moderator_comments(text: Column) -> Column:
    """array of (comment, moderator): bracketed passages signed by a moderator."""
    mod = r"-\s?Mod\.\s?(\w+)"
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)\[.+?\]"), F.lit(0)), lambda x: x.rlike(mod))
    return F.transform(found, lambda x: F.struct(x.alias("comment"), F.regexp_extract(x, mod, 1).alias("moderator")))


def without_comments(text: Column) -> Column:
    return F.aggregate(moderator_comments(text), text, lambda t, c: F.replace(t, c["comment"], F.lit("")))


def parsed_date(text: Column) -> Column:
    """UTC microseconds of a post's or article's date line; zone-less times count as UTC.

    The last day of a range in days counts; an offset after CST-nCDT or before a zone name counts; SEPT, TUES, WEDS and THUR(S) are understood.
    Offsets of three, or five and more digits, and blanks before colons make a date unreadable, as does a missing year."""
    t = F.upper(F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+$", ""))
    t = F.regexp_replace(t, r"\b\d{1,2}-(\d{1,2}\s\w{3,10}\s\d{4})\b", "$1")
    t = F.regexp_replace(t, r"CST(-?\d)CDT$", "$1")
    t = F.regexp_replace(t, r"(-\d{1,4})\s?[A-Z]{1,5}$", "$1")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bTHURS?\b", "THURSDAY"), r"\bTUES\b", "TUESDAY"), r"\bWEDS\b", "WEDNESDAY"), r"\bSEPT\b", "SEPTEMBER")
    t = F.regexp_replace(t, r"^(?:MON|TUES|WEDNES|THURS|FRI|SATUR|SUN)DAY\.?,?\s+", "")
    bad = t.rlike(r"-\d{3}(\d{2,})?$") | t.rlike(r"\s:")
    hours = F.regexp_replace(t, r" (-?)(\d)$", " GMT$1$2")  # a single digit after a blank is an offset in hours
    return F.when(~bad, TS.utc_micros(F.when(hours.rlike(r" GMT\d$"), F.regexp_replace(hours, "GMT", "GMT+")).otherwise(hours)))


def utc_of(local: Column, offset_s: Column) -> Column:
    """UTC microseconds of a local time with an offset in seconds; one of 24 to 48 hours is a day less, and the local time a day off."""
    day = F.lit(86400)
    reduced = F.when(offset_s >= day, offset_s - day).when(offset_s <= -day, offset_s + day).otherwise(offset_s)
    moved = F.when(offset_s >= day, local + TS.DAY).when(offset_s <= -day, local - TS.DAY).otherwise(local)
    return moved - reduced * TS.SECOND


def published(text: Column) -> Column:
    """UTC microseconds of a publication time, which is US Eastern: daylight time up to 1 November, else standard time."""
    local = TS.utc_micros(text)
    late = F.timestamp_micros(local) > F.make_timestamp(F.year(F.timestamp_micros(local)), F.lit(11), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return local + F.when(late, 5).otherwise(4).cast("bigint") * 3600 * TS.SECOND


def sane_date(found: Column, post: Column) -> Column:
    """An article's date, unless it lies before 1900 or more than a day after the post (all UTC microseconds)."""
    return F.when((F.year(F.timestamp_micros(found)) >= 1900) & (found <= post + TS.DAY), found)


def sections(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep + (idx, section): the stripped sections between lines of stars or hashes."""
    s = df.select(*keep, F.posexplode(F.split(text, SECTION)).alias("idx", "section"))
    return s.withColumn("section", F.regexp_replace("section", r"(?U)^\s+|(?<!\s)\s+$", ""))


def posts_of(posts: DataFrame, post: str, description: Column, names: DataFrame, name: str, published: str) -> DataFrame:
    """(name, post, nth): posts whose description holds a name, case aside and inside words too (names are text, not patterns), counted
    by publication within each name. The names, of a checked size, go to the tasks as one automaton, which reads each description once."""
    found = [r[0] for r in names.select(name).where(f"{name} <> ''").distinct().collect()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a: dict[str, list[str]] = {}
        for x in found:
            a.setdefault(x.lower(), []).append(x)
        machine = ahocorasick.Automaton()
        for k, v in a.items():
            machine.add_word(k, v)
        machine.make_automaton()
        for batch in batches:
            out = [(i, at, x) for i, at, text in zip(*(batch.column(c).to_pylist() for c in range(3))) if len(machine) for x in sorted({x for _, v in machine.iter(text.lower()) for x in v})]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), batch.schema.field(1).type, pa.string()))], names=[post, published, name])

    d = posts.select(post, published, description.alias("d")).where("d <> ''")
    kinds = dict(d.dtypes)
    hits = d.mapInArrow(rows, f"{post} {kinds[post]}, {published} {kinds[published]}, {name} string")
    order = Window.partitionBy(name).orderBy(F.col(published).asc_nulls_last(), post)
    return hits.select(name, post, F.row_number().over(order).cast("bigint").alias("nth"))


def article_fields(section: Column) -> dict[str, Column]:
    """date_text, source_name, source_edits, source_url, heading, communicated_by, content of one section."""
    date_rx, source_rx = r"(?m)^Date:\s([^(\[\n]+)", r"Source:\s([^\[\n]+)(?:\s(\[.*))?\n(http.+)?"
    head_end = F.regexp_instr(section, F.lit(r"(?m)^Date:\s|Source:\s[^\[\n]+"))
    before = F.when(head_end > 1, F.substring(section, F.lit(1), head_end - 1))
    tail = F.regexp_replace(section, r"(?s)^.*?(?=\n--\n)\n--\n.*$", "")
    body = F.when(tail != "", tail).otherwise(section)
    cut = F.when(section.rlike(r"(?s)^.*\n--\n|^--\n"), F.regexp_extract(section, r"(?s)^(.*?)(?:\n|^)--\n", 1)).otherwise(body)
    content = F.when(cut.rlike(source_rx), F.regexp_replace(cut, r"(?s)^.*?" + source_rx, "")).when(cut.rlike(date_rx), F.regexp_replace(cut, r"(?ms)^.*?^Date:\s[^(\[\n]+", "")).otherwise(cut)
    return {
        "date_text": _group(section, date_rx, 1), "source_name": _group(section, source_rx, 1), "source_edits": _group(section, source_rx, 2), "source_url": _group(section, source_rx, 3),
        "heading": _group(before, r"(?m)^(?:\[\d\]\s)?(\S.*)$", 1), "communicated_by": _group(section, COMMUNICATED, 1), "content": F.regexp_replace(content, r"(?U)^\s+|(?<!\s)\s+$", ""),
    }


def section_kind(idx: Column, section: Column, is_article: Column) -> Column:
    """article, notice, contents, various, empty, title or text; the rules apply in this order."""
    return (
        F.when(is_article, "article").when(section.rlike(NOTICE), "notice").when(section.rlike(CONTENTS), "contents").when(section.rlike(VARIOUS), "various")
        .when(section == "", "empty").when((idx == 0) & (F.length(section) - F.length(F.replace(section, F.lit("\n"), F.lit(""))) < 2), "title").otherwise("text")
    )


def articles(df: DataFrame, post: str, text: Column) -> DataFrame:
    """(post, article, section): the articles of each post; sections that are only text continue the article before them.

    The fold over the sections is a running count of article heads and breaks within one post."""
    s = sections(df, text, post)
    found = F.col("section").rlike(r"Source:\s[^\[\n]+(\s(\[.*))?\n") | F.col("section").rlike(r"(?m)^Date:\s[^(\[\n]+")
    s = s.withColumn("kind", section_kind(F.col("idx"), F.col("section"), found))
    s = s.withColumn("piece", F.when(F.col("kind").isin("article", "text"), F.col("section")))
    per = s.groupBy(post).agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "piece"))).alias("s"))

    def fold(acc: Column, x: Column) -> Column:
        last = F.size(acc["done"])
        opened = F.struct(F.concat(acc["done"], F.array(x["piece"])).alias("done"), F.lit(True).alias("open"))
        grown = F.struct(F.concat(F.slice(acc["done"], 1, F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["done"], -1), F.lit("\n#####\n"), x["piece"]))).alias("done"), F.lit(True).alias("open"))
        shut = F.struct(acc["done"].alias("done"), F.lit(False).alias("open"))
        return F.when(x["kind"] == "article", opened).when((x["kind"] == "text") & acc["open"], grown).otherwise(shut)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("open"))
    return per.select(post, F.posexplode(F.aggregate("s", start, fold, lambda a: a["done"])).alias("article", "section"))
