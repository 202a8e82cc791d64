"""Queries over the test tables for the problems of training text, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, table
from . import boilerplate, langid, leakage, mojibake, neardup, overlap, packing, sharedspans


def _content():
    return F.col("private.cleancontent.content")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p2_found")
    d = neardup.signatures(table(spark, sf, "corpus_item"), F.col("item_id"), _content(), F.lit(0))
    pairs, copies, _ = neardup.similar_pairs(d, scratch, 0.5)
    return neardup.all_pairs(pairs, copies)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record that is like another: its group and its number of links to other representatives (copies aside)."""
    scratch = Scratch(spark, "p2_groups")
    d = neardup.signatures(table(spark, sf, "corpus_item"), F.col("item_id"), _content(), F.lit(0))
    pairs, copies, _ = neardup.similar_pairs(d, scratch, 0.5)
    pairs = scratch.save(pairs.select("a", "b"))
    groups = scratch.save(neardup.components(pairs.union(copies.select("rep", "id")), scratch))
    links = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    own = groups.join(copies, "id", "left").withColumn("r", F.coalesce("rep", "id"))
    return own.join(links.withColumnRenamed("id", "r"), "r", "left").select(F.col("id").alias("item_id"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p4_found")
    return overlap.overlap_pairs(table(spark, sf, "corpus_item"), "item_id", F.col("name"), _content(), F.col("split"), scratch, 0.5)


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation records that overlap with training by name or content, and their pairs, per split and source."""
    scratch = Scratch(spark, "p4_counts")
    return overlap.overlap_counts(table(spark, sf, "corpus_item"), "item_id", F.col("name"), _content(), F.col("split"), F.col("source"), scratch, 0.5)


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_counts": p4_counts}
ORACLE = {}


def _language_model(d: DataFrame):
    return langid.fit(*langid.labelled_sample(d, F.col("item_id"), _content(), F.col("lang")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "corpus_item")
    fields = {"content": (_content(), F.col("lang")), "translation": (F.col("private.englishtranslation.content"), F.lit("en"))}
    return langid.wrong_labels(d, _language_model(d), F.col("item_id"), fields).distinct().withColumnRenamed("id", "item_id")


def p3_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every paragraph of contents and translations."""
    d = table(spark, sf, "corpus_item")
    fields = {"content": _content(), "translation": F.col("private.englishtranslation.content")}
    return langid.label_paragraphs(d, _language_model(d), F.col("item_id"), fields).withColumnRenamed("id", "item_id")


QUERIES |= {"p3_found": p3_found, "p3_segments": p3_segments}


def _spans(spark: SparkSession, sf: str, name: str):
    return sharedspans.SharedSpans(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), Scratch(spark, name))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf, "p10_found").found().withColumnRenamed("id", "doc_id")


def p10_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of a document that also stands in another row."""
    s = _spans(spark, sf, "p10_spans").spans()
    return s.select(F.col("id").alias("doc_id"), F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"))


def p10_share(spark: SparkSession, sf: str) -> DataFrame:
    """For each document with shared spans, how much of its text stands elsewhere."""
    s = p10_spans(spark, sf).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars")).dropDuplicates(["doc_id"])
    return s.join(d, "doc_id").select("doc_id", "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("share"))


QUERIES |= {"p10_found": p10_found, "p10_spans": p10_spans, "p10_share": p10_share}


def _leaked(spark: SparkSession, sf: str, name: str, **how) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_item")
    return leakage.leaked(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"), Scratch(spark, name), **how)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaked(spark, sf, "p9_found").select("doc_id", "item_id")


def p9_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that repeat at least 40 words of an item with other numbers, names or units put in consistently."""
    return _leaked(spark, sf, "p9_templates", least=40, mode="consistent")


QUERIES |= {"p9_found": p9_found, "p9_templates": p9_templates}


def _labeller(spark: SparkSession, sf: str) -> boilerplate.Labeller:
    pages, items = table(spark, sf, "scrape_result"), table(spark, sf, "corpus_item")
    sample = boilerplate.training_pages(pages, F.col("scrape_id"), F.col("htmlcontent"), F.col("item_name"), items, F.col("name"), _content(), F.col("code") >= 400)
    return boilerplate.fit(sample)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    model = _labeller(spark, sf)
    return boilerplate.paragraph_keys(table(spark, sf, "scrape_result"), F.col("scrape_id"), F.col("htmlcontent"), model).withColumnRenamed("id", "scrape_id")


def p5_text(spark: SparkSession, sf: str) -> DataFrame:
    """The article of each page, one row for each of its paragraphs."""
    model = _labeller(spark, sf)
    return boilerplate.main_text(table(spark, sf, "scrape_result"), F.col("scrape_id"), F.col("htmlcontent"), model).withColumnRenamed("id", "scrape_id")


QUERIES |= {"p5_found": p5_found, "p5_text": p5_text}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_rows(table(spark, sf, "scrape_result"), F.col("scrape_id"), F.col("htmlcontent")).withColumnRenamed("id", "scrape_id")


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled pages with their text restored."""
    return mojibake.repaired_rows(table(spark, sf, "scrape_result"), F.col("scrape_id"), F.col("htmlcontent")).withColumnRenamed("id", "scrape_id")


QUERIES |= {"p1_found": p1_found, "p1_repaired": p1_repaired}


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of 2,048 tokens that each document, or piece of a longer one, goes into."""
    sizes = packing.token_counts(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))
    return packing.packed(sizes, Scratch(spark, "p8_containers")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers are filled."""
    p = p8_containers(spark, sf).groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return p.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("n").alias("pieces")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * packing.CAPACITY), 6))


QUERIES |= {"p8_containers": p8_containers, "p8_fill": p8_fill}


# Brute force in SQL: all runs of words, or all windows of characters, as text.
_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_SETS = f"""w AS (SELECT item_id, name, split, {_W.format('private.cleancontent.content')} AS w FROM corpus_item),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
o AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.item_id < b.item_id GROUP BY ALL),
near AS (SELECT x AS item_id_a, y AS item_id_b FROM o JOIN n a ON a.item_id = x JOIN n b ON b.item_id = y WHERE 2 * o >= a.n + b.n - o)"""
ORACLE["p2_found"] = f"WITH {_SETS} SELECT * FROM near"
_CROSS = f"""{_SETS}, s AS (SELECT item_id, split, source, CASE WHEN split = 'training' THEN 0 WHEN split IN ('mixed_test', 'time_offset_test') THEN 1 END AS side,
nullif(lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')), '') AS name, nullif(trim(regexp_replace(lower(private.cleancontent.content), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '') AS key FROM corpus_item),
p AS (SELECT item_id_a, item_id_b FROM near JOIN s a ON a.item_id = item_id_a JOIN s b ON b.item_id = item_id_b WHERE a.side + b.side = 1
UNION SELECT a.item_id, b.item_id FROM s a JOIN s b ON a.name = b.name AND a.item_id < b.item_id WHERE a.side + b.side = 1)"""
ORACLE["p4_found"] = f"WITH {_CROSS} SELECT item_id_a, item_id_b FROM p"
ORACLE["p4_counts"] = f"""WITH {_CROSS}, ends AS (SELECT item_id, count(*) AS n FROM (SELECT item_id_a AS item_id FROM p UNION ALL SELECT item_id_b FROM p) GROUP BY item_id), t AS (SELECT DISTINCT key FROM s WHERE side = 0 AND key IS NOT NULL)
SELECT split, source, count(*)::BIGINT AS rows, count(*) FILTER (WHERE t.key IS NOT NULL OR ends.n IS NOT NULL)::BIGINT AS leaked, count(t.key)::BIGINT AS exact, coalesce(sum(ends.n), 0)::BIGINT AS pairs FROM s LEFT JOIN t ON s.key = t.key LEFT JOIN ends ON ends.item_id = s.item_id WHERE side = 1 GROUP BY split, source"""
# groups: the least id reached over the pairs; copies: pairs of equal sets
ORACLE["p2_groups"] = f"""WITH RECURSIVE {_SETS}, ways AS (SELECT item_id_a AS a, item_id_b AS b FROM near UNION ALL SELECT item_id_b, item_id_a FROM near),
reach AS (SELECT a AS item_id, b AS r FROM ways UNION SELECT reach.item_id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
same AS (SELECT x AS a, y AS b FROM o JOIN n p ON p.item_id = x JOIN n q ON q.item_id = y WHERE o = p.n AND o = q.n),
rep AS (SELECT item_id, least(item_id, coalesce(min(b), item_id)) AS rep FROM (SELECT item_id, s.b FROM n LEFT JOIN (SELECT a, b FROM same UNION ALL SELECT b, a FROM same) s ON s.a = n.item_id) GROUP BY item_id),
links AS (SELECT u.rep, count(DISTINCT v.rep) AS n_links FROM ways JOIN rep u ON u.item_id = ways.a JOIN rep v ON v.item_id = ways.b WHERE u.rep <> v.rep GROUP BY u.rep)
SELECT item_id, least(item_id, min(r)) AS group_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links FROM reach JOIN rep USING (item_id) LEFT JOIN links USING (rep) GROUP BY item_id"""
ORACLE["p9_found"] = f"""WITH e AS (SELECT item_id, {_W.format('text')} AS w FROM eval_item), d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents),
er AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 19], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS i FROM e WHERE len(w) >= 20)),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 19], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20))
SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r)"""
ORACLE["p10_found"] = """WITH w AS (SELECT doc_id, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)) SELECT DISTINCT doc_id FROM w JOIN s USING (h)"""

_COVER = """w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), m AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN s USING (h)),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m),
c AS (SELECT doc_id, min(i) - 1 AS span_start, max(i) + 199 AS span_end FROM g GROUP BY doc_id, g)"""
ORACLE["p10_spans"] = f"WITH {_COVER} SELECT doc_id, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end FROM c"
ORACLE["p10_share"] = f"WITH {_COVER} SELECT doc_id, length(text)::BIGINT AS chars, sum(span_end - span_start)::BIGINT AS shared_chars, round(sum(span_end - span_start) / length(text), 6) AS share FROM c JOIN documents USING (doc_id) GROUP BY doc_id, text"


def p5_leftovers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of stored contents that are page furniture."""
    scratch = Scratch(spark, "p5_leftovers")
    counts = scratch.save(boilerplate.line_counts(table(spark, sf, "scrape_result"), F.col("scrape_id"), F.col("htmlcontent"), _labeller(spark, sf), F.col("item_name")))
    keys = scratch.save(boilerplate.furniture(counts))
    own = boilerplate.own_exceptions(counts, keys)
    return boilerplate.leftovers(table(spark, sf, "corpus_item"), F.col("item_id"), _content(), keys, F.col("name"), own).withColumnRenamed("id", "item_id")


QUERIES["p5_leftovers"] = p5_leftovers
