"""Text functions as column expressions, all inside the JVM. Null in gives null out unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"http\S*[\p{L}\p{N}_]|[\p{L}\p{N}_]+"
BLANK_ENDS = r"(?U)^\s+|(?<!\s)\s+$"  # the look-behind keeps long runs of blanks linear

# Common English words that Spanish does not share.
ENGLISH_WORDS = """
the be to of and in that have I it for not on with he as you do at this but his by from they we say her she or an will my
one all would there their what so up out if about who get which go me when make can like time just him know take people into
year your good some could them see other than then now look only come its over think also back after use two how our work
first well way even new want because any these give day most us
""".split()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; plain reuse of a column copies its expression into every place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, BLANK_ENDS, "")


def tokens(text: Column, lower: bool = True) -> Column:
    """Words (letters, digits, underscore) and URLs, one-character words included."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def normalised_keyword(keyword: Column, lower: bool = True) -> Column:
    """The keyword's tokens joined by single blanks."""
    return F.array_join(tokens(keyword, lower), " ")


def ngrams(toks: Column, most: int = 5) -> Column:
    """All runs of 1 to `most` consecutive tokens, joined by blanks."""

    def of(n: int) -> Column:
        last = F.size(toks) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(1, most + 1)])


def english_matches(text: Column) -> Column:
    """The common English words in the text in order, as written; word ends are ASCII ends, case is ignored."""
    words = "|".join(sorted(ENGLISH_WORDS, key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(text, F.lit(f"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"), F.lit(1))


def is_english(text: Column) -> Column:
    """True iff, at some word seen for the first time, more than min(5, n) different words and more than n words were met,
    n being a hundredth of the length. Equivalent to: enough different words, and the last new one comes late enough."""
    n = F.floor(F.length(text) / 100)

    def late(found: Column) -> Column:
        return let(F.array_distinct(found), lambda words: (F.size(words) > F.least(F.lit(5), n)) & (F.array_max(F.transform(words, lambda w: F.array_position(found, w))) > n))

    return F.coalesce(let(english_matches(text), late), F.lit(False) & text.isNotNull())


def selected_text(translation: Column, content: Column) -> Column:
    """The English translation if there is one, else the content."""
    return F.coalesce(F.when(translation != "", translation), content)


def training_text(translation: Column, error: Column, translated: Column, content: Column) -> Column:
    """The text to train on: the translation of an item that has one (translated), else the content. A translation with an error, or without text, raises."""
    bad = translated & (error.isNotNull() | translation.isNull() | (translation == ""))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad translation: "), F.coalesce(error, F.lit("empty")))).cast("string")).when(translated, translation).otherwise(content)


def chunks(text: Column, most: int = 5000) -> Column:
    """The text in greedy pieces of at most `most` characters plus the white space they end at; longer words fall out."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{most}}}(?:\s|$))"), F.lit(1))


def squashed_label(c: Column) -> Column:
    """Lower case without anything but ASCII word characters."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9_]", "")


def split_trimmed(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def lemma_name(c: Column) -> Column:
    """The text before the first full stop, underscores as blanks."""
    return F.replace(F.split_part(c, F.lit("."), F.lit(1)), F.lit("_"), F.lit(" "))


def without_qualifier(c: Column) -> Column:
    """Drops " (disorder)", " (morphologic abnormality)", " (finding)" and empty brackets."""
    return F.regexp_replace(c, r"\s\((disorder|(morphologic abnormality)|finding)?\)", "")


def up_to_last(text: Column, end: str, body) -> Column:
    """body(the text up to its last match of `end`) and what follows. Within it every opening finds an end, so a pattern from an opening
    to its end takes linear time, however many openings are never closed."""
    head = F.regexp_extract(text, f"(?is)^.*{end}", 0)
    return let(head, lambda h: F.concat(body(h), F.substring(text, F.length(h) + 1, F.length(text))))


def without_elements(html: Column, *names: str, by: str = "") -> Column:
    """The markup with closed elements of these names, tags included, replaced."""
    for n in names:
        html = up_to_last(html, rf"</{n}\s*>", lambda h, n=n: F.regexp_replace(h, rf"(?is)<{n}\b.*?</{n}\s*>", by))
    return html


def without_tags(html: Column, tag: str, by: str) -> Column:
    """The markup with tags that match `tag` (a pattern that begins with < and leaves out the rest up to >) replaced."""
    return up_to_last(html, ">", lambda h: F.regexp_replace(h, tag + "[^>]*>", by))


def html_to_text(html: Column) -> Column:
    """Markup to plain text: paragraphs and headings end in a blank line, br in a line end; other white space is one blank.

    Each step is linear in the text, whatever is left unclosed."""

    def plain(h: Column) -> Column:
        t = F.regexp_replace(h, "\u00a0|&nbsp;", " ")
        t = F.regexp_replace(t, r"[ \t\r\n\f]+", " ")
        t = let(without_tags(t, r"(?i)<br", "\n"), lambda x: without_tags(x, r"(?i)</?(?:h[0-9]|p)", "\n\n"))
        t = let(t, lambda x: without_tags(x, r"<[/!a-zA-Z]", ""))
        return F.regexp_replace(F.regexp_replace(t, r"(?<! ) *+\n *+", "\n"), r"\n{3,}", "\n\n")

    return let(let(without_elements(html, "script", by=" "), lambda h: without_elements(h, "style", by=" ")), plain)


def bool_argument(c: Column) -> Column:
    """"true" or "false" in any case; anything else raises."""
    low = F.lower(c)
    return F.when(low == "true", True).when(low == "false", False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def record_name(prefix: str, record_id: Column) -> Column:
    return F.concat(F.lit(prefix), record_id)


def resource_url(record_id: Column, collection: Column, branch: str = "master") -> Column:
    return F.concat(F.lit("/resource/"), F.lit(branch), F.lit("/"), collection, F.lit("/"), record_id)
