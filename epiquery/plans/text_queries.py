"""Text, URL and feature operators over the documents and stored items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as PG
from ..functions import structs as ST
from ..functions import text as X
from ..functions import url as U
from ..operators import diagnose as D
from ..operators import features as FE
from ..operators import scoring as S
from ..storage import Scratch, spread, table
from . import shared as H
from .general import instants_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


@query(f"""SELECT token, count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM (SELECT doc_id, token, count(*) AS n FROM
(SELECT doc_id, unnest({H.sql_tokens('lower(text)')}) AS token FROM documents) GROUP BY ALL) GROUP BY token""")
def token_counts(spark, sf):
    return FE.token_counts(_docs(spark, sf), "doc_id", F.col("text"))


@query(f"""WITH t AS (SELECT doc_id, {H.sql_tokens('lower(text)')} AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t), k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
g AS (SELECT doc_id, count(DISTINCT array_to_string(t[i:i + k - 1], ' '))::BIGINT AS n FROM p, k WHERE i + k - 1 <= len(t) GROUP BY doc_id)
SELECT doc_id, len(t)::BIGINT AS tokens, coalesce(n, 0) AS ngrams FROM t LEFT JOIN g USING (doc_id)""")
def ngram_sizes(spark, sf):
    """Tokens and distinct 1- to 5-grams of each document."""
    d = _docs(spark, sf).where("text is not null").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct(X.ngrams(F.col("t")))).cast("bigint").alias("ngrams"))


def _model(spark, sf, name):
    return D.LabelModel(table(spark, sf, "label_table"), Scratch(spark, name))


@query(H.with_("SELECT doc_id, keyword, n FROM base", H.LABELS, H.KEYWORDS))
def keyword_match(spark, sf):
    return _model(spark, sf, "keyword_match").base(_docs(spark, sf), "doc_id", F.col("text"))


CASE_TERMS = "('NÃO'), ('SÃO'), ('SITREP'), ('ATENÇÃO'), ('East'), ('of')"


@query(f"""WITH t AS (SELECT col0 AS k FROM (VALUES {CASE_TERMS})), d AS (SELECT doc_id, unnest({H.sql_tokens('text')}) AS w FROM documents),
ci AS (SELECT doc_id, k AS keyword, count(*) AS n FROM d JOIN t ON lower(w) = lower(k) GROUP BY ALL),
cs AS (SELECT doc_id, k AS keyword, count(*) AS n FROM d JOIN t ON w = k AND upper(k) = k AND length(k) <= 6 GROUP BY ALL)
SELECT doc_id, keyword, coalesce(cs.n, ci.n)::BIGINT AS n FROM ci FULL JOIN cs USING (doc_id, keyword)""")
def case_overlay(spark, sf):
    """Counts without case, replaced by exact ones for short upper-case keywords."""
    from ..operators import lexicon as L

    t = H.inline(spark, CASE_TERMS, "k")
    w = _docs(spark, sf).select("doc_id", F.explode(X.tokens(F.col("text"), lower=False)).alias("w"))
    count = lambda k, cond: w.join(F.broadcast(k), F.expr(cond)).groupBy("doc_id", F.col("k").alias("keyword")).agg(F.count("*").alias("n"))
    return FE.overlaid(count(t, "lower(w) = lower(k)"), count(t.where(L.is_case_sensitive(F.col("k"))), "w = k"), "doc_id")


@query(H.with_("SELECT doc_id, feature, value FROM lf", H.LABELS, H.KEYWORDS, H.FEATURES))
def linked_features(spark, sf):
    m = _model(spark, sf, "linked_features")
    return FE.linked(m.base(_docs(spark, sf), "doc_id", F.col("text")), m.links, "doc_id")


@query(H.with_("SELECT doc_id, feature, value FROM feat", H.LABELS, H.KEYWORDS, H.FEATURES))
def clamped_features(spark, sf):
    m = _model(spark, sf, "clamped_features")
    return m.features(m.base(_docs(spark, sf), "doc_id", F.col("text")), "doc_id")


@query(H.with_("SELECT DISTINCT doc_id FROM feat", H.LABELS, H.KEYWORDS, H.FEATURES))
def zero_vector_filter(spark, sf):
    m = _model(spark, sf, "zero_vector_filter")
    f = m.features(m.base(_docs(spark, sf), "doc_id", F.col("text")), "doc_id")
    return FE.without_zero_vectors(_docs(spark, sf).select("doc_id").distinct(), f, "doc_id")


RENAMES = "('deaths', 'death'), ('death', 'fatality'), ('cases', 'case'), ('case', 'cases'), ('patients', 'case')"


@query(f"""WITH RECURSIVE m AS (SELECT col0 AS a, col1 AS b FROM (VALUES {RENAMES})),
w AS (SELECT a, b, [b] AS path, 1 AS d FROM m UNION ALL SELECT w.a, m.b, list_append(path, m.b), d + 1 FROM w JOIN m ON m.a = w.b WHERE NOT list_contains(path, m.b)),
ends AS (SELECT a, CASE WHEN arg_max(b, d) IN (SELECT a FROM m) THEN list_min(arg_max(path, d)) ELSE arg_max(b, d) END AS target FROM w GROUP BY a),
t AS (SELECT doc_id, unnest({H.sql_tokens('lower(text)')}) AS k FROM documents)
SELECT doc_id, coalesce(target, k) AS keyword, count(*)::BIGINT AS n FROM t LEFT JOIN ends ON k = a WHERE k IN ('deaths', 'death', 'fatality', 'cases', 'case', 'patients') GROUP BY ALL""")
def rename_merge(spark, sf):
    """Chains of renames are followed to their end; in a cycle the smallest name on the way is the target."""
    renames = H.inline(spark, RENAMES, "keyword, target")
    every = renames.select("keyword").union(renames.select("target")).distinct()
    counts = _docs(spark, sf).select("doc_id", F.explode(X.tokens(F.col("text"))).alias("keyword")).join(F.broadcast(every), "keyword").groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))
    return FE.renamed(counts, F.broadcast(FE.resolved_renames(renames, Scratch(spark, "rename_merge"))), "doc_id")


_EN = "|".join(sorted(X.ENGLISH_WORDS, key=lambda w: (-len(w), w)))


@query(rf"""WITH d AS (SELECT doc_id, length(text) // 100 AS n, regexp_extract_all(text, '(?i)\b({_EN})\b') AS m FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, n, m, list_distinct(m) AS u FROM d)
SELECT doc_id, coalesce(len(u) > least(5, n) AND list_max(list_transform(u, lambda w: list_position(m, w))) > n, false) AS english, len(m)::BIGINT AS matches, len(u)::BIGINT AS words FROM u""")
def english_detect(spark, sf):
    d = _docs(spark, sf).where("text is not null")
    m = X.english_matches(F.col("text"))
    return d.select("doc_id", X.is_english(F.col("text")).alias("english"), F.size(m).cast("bigint").alias("matches"), F.size(F.array_distinct(m)).cast("bigint").alias("words"))


@query("""SELECT item_id, md5(coalesce(nullif(private.englishtranslation.content, ''), private.cleancontent.content)) AS text_md5, length(coalesce(nullif(private.englishtranslation.content, ''), private.cleancontent.content))::BIGINT AS chars FROM corpus_item""")
def text_select(spark, sf):
    t = X.selected_text(F.col("private.englishtranslation.content"), F.col("private.cleancontent.content"))
    return table(spark, sf, "corpus_item").select("item_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("chars"))


@query(r"""SELECT doc_id, (i - 1)::BIGINT AS chunk, md5(c[i]) AS chunk_md5 FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.{1,1000}(?:\s|$))') AS c FROM documents))""")
def translate_chunks(spark, sf):
    """Pieces of at most 1,000 characters, cut at white space."""
    c = X.chunks(F.col("text"), 1000)
    return _docs(spark, sf).select("doc_id", F.posexplode(c).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.md5("c").alias("chunk_md5"))


@query(r"""WITH u AS (SELECT scrape_id, sourceurl AS url, nullif(regexp_extract(sourceurl, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host, regexp_extract(sourceurl, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path FROM scrape_result)
SELECT scrape_id, host, CASE WHEN url IS NULL THEN 'none' WHEN path LIKE '%.pdf' THEN 'unscrapable' WHEN host IS NULL THEN 'unscrapable' WHEN contains(host, 'promed') THEN 'post' WHEN contains(host, 'empres-i.fao.org') OR contains(host, 'twitter.com') THEN 'unscrapable' WHEN contains(host, 'news.google.com') THEN 'unwrap' ELSE 'fetch' END AS route,
coalesce(regexp_matches(host, '^.+\.\D+'), false) AS valid_host FROM u""")
def url_route(spark, sf):
    u = F.col("sourceurl")
    return table(spark, sf, "scrape_result").select("scrape_id", U.host(u).alias("host"), U.route(u).alias("route"), U.valid_host(u).alias("valid_host"))


@query(r"""WITH a AS (SELECT scrape_id, regexp_replace(regexp_replace(htmlcontent, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '\x{A0}|&nbsp;', ' ', 'g') AS t FROM scrape_result WHERE htmlcontent IS NOT NULL),
b AS (SELECT scrape_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\n\f]+', ' ', 'g'), '(?i)<br[^>]*>', chr(10), 'g'), '(?i)</?(?:h[0-9]|p)[^>]*>', chr(10) || chr(10), 'g') AS t FROM a)
SELECT scrape_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '<[/!a-zA-Z][^>]*>', '', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text_md5 FROM b""")
def html_to_text(spark, sf):
    return table(spark, sf, "scrape_result").where("htmlcontent is not null").select("scrape_id", F.md5(X.html_to_text(F.col("htmlcontent"))).alias("text_md5"))


@query("""SELECT scrape_id, CASE WHEN unscrapable THEN coalesce(exception_text, msg) END AS error, len(redirects)::BIGINT AS hops FROM scrape_result WHERE unscrapable OR len(redirects) > 0""")
def scrape_errors(spark, sf):
    """Short-circuit of unscrapable pages, and the redirects of the rest."""
    s = table(spark, sf, "scrape_result").where(F.col("unscrapable") | (F.size("redirects") > 0))
    return s.select("scrape_id", F.when(F.col("unscrapable"), F.coalesce("exception_text", "msg")).alias("error"), F.when(F.col("redirects").isNotNull(), F.size("redirects")).cast("bigint").alias("hops"))


@query(H.with_("SELECT doc_id, class, round(p, 9) AS p FROM p", H.LABELS, H.KEYWORDS, H.FEATURES, H.SCORES))
def score_sigmoid(spark, sf):
    m = _model(spark, sf, "score_sigmoid")
    f = m.features(m.base(_docs(spark, sf), "doc_id", F.col("text")), "doc_id")
    return S.probabilities(f, m.coefficients, m.intercepts, "doc_id").withColumn("p", F.round("p", 9))


@query(H.with_("SELECT doc_id, class, round(p, 9) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, class) AS rank FROM guess", H.LABELS, H.KEYWORDS, H.FEATURES, H.SCORES))
def diagnose_ranked(spark, sf):
    m = _model(spark, sf, "diagnose_ranked")
    return D.ranked(D.diagnose(_docs(spark, sf), "doc_id", F.col("text"), m), "doc_id").withColumn("p", F.round("p", 9))


_EXPLAIN = """SELECT doc_id, class, feature, round(score, 9) AS score, direct FROM (SELECT g.doc_id, g.class, f.feature, p * CASE WHEN norm > 0 THEN s / norm ELSE s END AS score, b.doc_id IS NOT NULL AS direct
FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY doc_id, class)) AS norm FROM (SELECT f.doc_id, c.class, f.feature, coef * value AS s FROM feat f JOIN coef c USING (feature) JOIN guess g ON g.doc_id = f.doc_id AND g.class = c.class)) f
JOIN guess g ON g.doc_id = f.doc_id AND g.class = f.class LEFT JOIN base b ON b.doc_id = f.doc_id AND b.keyword = f.feature) WHERE score > 0"""


@query(H.with_(_EXPLAIN, H.LABELS, H.KEYWORDS, H.FEATURES, H.SCORES))
def explain_scores(spark, sf):
    m = _model(spark, sf, "explain_scores")
    base = m.base(_docs(spark, sf), "doc_id", F.col("text"))
    f = m.features(base, "doc_id")
    g = S.best_guess(m.scratch.save(S.probabilities(f, m.coefficients, m.intercepts, "doc_id")), m.ancestors, "doc_id")
    return S.explanations(g, f, base.withColumnRenamed("keyword", "feature"), m.coefficients, "doc_id").withColumn("score", F.round("score", 9))


@query(H.with_(f"""SELECT g.doc_id, (row_number() OVER (PARTITION BY g.doc_id ORDER BY p DESC, class DESC) - 1)::BIGINT AS place, class AS name, round(p, 6) AS probability, coalesce(x.direct, 0)::BIGINT AS keywords, coalesce(x.inferred, 0)::BIGINT AS inferred_keywords
FROM guess g LEFT JOIN (SELECT doc_id, class, count(*) FILTER (WHERE direct) AS direct, count(*) FILTER (WHERE NOT direct) AS inferred FROM ({_EXPLAIN}) GROUP BY ALL) x USING (doc_id, class)""", H.LABELS, H.KEYWORDS, H.FEATURES, H.SCORES))
def diagnose_json(spark, sf):
    """The answers as JSON documents, read back: their diseases in order, with how many keywords explain each."""
    m = _model(spark, sf, "diagnose_json")
    base = m.base(_docs(spark, sf), "doc_id", F.col("text"))
    f = m.features(base, "doc_id")
    g = S.best_guess(m.scratch.save(S.probabilities(f, m.coefficients, m.intercepts, "doc_id")), m.ancestors, "doc_id")
    answers = D.as_json(g, S.explanations(g, f, base.withColumnRenamed("keyword", "feature"), m.coefficients, "doc_id"), "doc_id")
    read = F.from_json("result", "diseases array<struct<probability: double, name: string, keywords: array<struct<name: string, score: double>>, inferred_keywords: array<struct<name: string, score: double>>>>")
    d = answers.select("doc_id", F.posexplode(read["diseases"]).alias("place", "d"))
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("bigint")
    return d.select("doc_id", F.col("place").cast("bigint").alias("place"), F.col("d.name").alias("name"), F.round("d.probability", 6).alias("probability"), size(F.col("d.keywords")).alias("keywords"), size(F.col("d.inferred_keywords")).alias("inferred_keywords"))


_HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


@query("WITH " + instants_sql("SELECT i.item_id, i.meta.date AS t, NULL::VARCHAR AS tz FROM corpus_item i") + rf""", q AS (SELECT i.item_id, i.meta.date AS date, utc_us, private.cleancontent.content AS content, private.scrapeddata.url AS url FROM corpus_item i LEFT JOIN instants USING (item_id)),
e AS (SELECT *, CASE WHEN date <> '' AND utc_us IS NULL THEN 'Could not parse content date' WHEN content <> '' THEN NULL WHEN url <> '' THEN CASE WHEN regexp_matches({_HOST}, '^.+\.\D+') THEN NULL ELSE 'Invalid URL' END ELSE 'Please provide a url or content to diagnose.' END AS error FROM q)
SELECT item_id, CASE WHEN error IS NULL THEN CASE WHEN content <> '' THEN 'text' ELSE 'fetch' END END AS action, error FROM e""")
def requests_dispatched(spark, sf):
    """Every stored item as a request: whether its text is diagnosed, its page fetched, or what is wrong with it."""
    r = table(spark, sf, "corpus_item").select("item_id", F.col("meta.date").alias("date"), F.col("private.cleancontent.content").alias("content"), F.col("private.scrapeddata.url").alias("url"))
    return D.dispatched(r, F.col("content"), F.col("url"), F.col("date")).select("item_id", "action", "error")


_TOP = "(SELECT doc_id, concat_ws(chr(10), doctype, text) AS text FROM documents ORDER BY doc_id LIMIT 200)"


@query(H.with_(f"SELECT t.doc_id AS scrape_position, class, round(p, 9) AS p FROM {_TOP} t LEFT JOIN guess USING (doc_id)", H.LABELS, H.KEYWORDS.replace("FROM documents WHERE text IS NOT NULL", f"FROM {_TOP}"), H.FEATURES, H.SCORES))
def search_top200(spark, sf):
    """The first 200 search results, title and content, diagnosed."""
    got = D.search_and_diagnose(_docs(spark, sf), "doc_id", F.col("doctype"), F.col("text"), _model(spark, sf, "search_top200"))
    return got.select(F.col("doc_id").alias("scrape_position"), "class", F.round("p", 9).alias("p"))


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_type FROM events WHERE props IS NOT NULL""")
def json_props(spark, sf):
    return table(spark, sf, "events").where("props is not null").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def event_windows(spark, sf):
    """Windowed counts, as the stream gives them (an extension)."""
    from ..streaming.jobs import windowed_counts

    return windowed_counts(table(spark, sf, "events")).withColumn("value", F.round("value", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""")
def vector_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("norm"))


@query("""SELECT item_id, private.cleancontent.malformed AS "private/cleancontent/malformed", private.scrapeddata.url AS "private/scrapeddata/url", private.englishtranslation.error AS "private/englishtranslation/error" FROM corpus_item""")
def squashed_items(spark, sf):
    """Nested items as flat columns named by path."""
    flat = ST.squashed(table(spark, sf, "corpus_item").select("item_id", "private"))
    return flat.select("item_id", *[F.col(f"`private/{c}`") for c in ("cleancontent/malformed", "scrapeddata/url", "englishtranslation/error")])


@query()
def page_content(spark, sf):
    """Main text of pages by the plain density rule, and whether it is malformed."""
    s = table(spark, sf, "scrape_result").where("htmlcontent is not null").select("scrape_id", PG.main_text(F.col("htmlcontent")).alias("content"))
    return s.withColumn("malformed", PG.malformed(F.col("content")))


@query("""SELECT scrape_id, md5(htmlcontent) AS text_md5 FROM scrape_result WHERE htmlcontent IS NOT NULL""")
def decoded_bytes(spark, sf):
    """Bytes of whole pages, decoded without being told their encoding."""
    s = table(spark, sf, "scrape_result").where("htmlcontent is not null")
    return s.select("scrape_id", F.md5(PG.decoded(F.encode("htmlcontent", "utf-8"), F.lit(None).cast("string"))).alias("text_md5"))


@query(H.with_("SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS index FROM (SELECT DISTINCT feature FROM feat)", H.LABELS, H.KEYWORDS, H.FEATURES))
def feature_vocabulary(spark, sf):
    """All features of the documents, numbered in their order."""
    from ..operators import train as TR

    m = _model(spark, sf, "feature_vocabulary")
    return TR.vocabulary(m.features(m.base(_docs(spark, sf), "doc_id", F.col("text")), "doc_id"), m.scratch)


@query("""WITH e AS (SELECT item_id, CASE WHEN private.cleancontent.content <> '' THEN NULL WHEN private.scrapeddata.url <> '' THEN CASE WHEN regexp_matches(regexp_extract(private.scrapeddata.url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^.+\\.\\D+') THEN NULL ELSE 'Invalid URL' END ELSE 'Please provide a url or content to diagnose.' END AS error, private.cleancontent.content AS t FROM corpus_item)
SELECT item_id, md5(CASE WHEN error IS NOT NULL THEN '{"error":"' || error || '"}' WHEN t IS NOT NULL THEN '{"n":' || length(t) || ', "source": {"cleanContent":' || to_json({'content': t})::VARCHAR || '}}' ELSE '{"n":0}' END) AS answer_md5 FROM e""")
def answers_json(spark, sf):
    """The JSON answer to each item as a request: an error, or a result with its source text."""
    r = table(spark, sf, "corpus_item").select("item_id", F.col("private.cleancontent.content").alias("t"), F.col("private.scrapeddata.url").alias("url"))
    d = D.dispatched(r, F.col("t"), F.col("url"), F.lit(None).cast("string")).withColumn("result", F.concat(F.lit('{"n":'), F.coalesce(F.length("t"), F.lit(0)).cast("string"), F.lit("}")))
    return d.select("item_id", F.md5(D.answered(d, "result", "error", F.col("t"))).alias("answer_md5"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def stream_windows(spark, sf):
    """The windowed counts as a stream gives them: the event files read as micro-batches, with a watermark, until all is read."""
    from ..streaming.jobs import collected_windows

    got = collected_windows(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, Scratch(spark, "stream_windows").root)
    return got.withColumn("value", F.round("value", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(H.with_("SELECT doc_id, class, round(p, 9) AS p FROM guess", H.LABELS, H.KEYWORDS, H.FEATURES, H.SCORES))
def stream_diagnosed(spark, sf):
    """The documents read as a stream and diagnosed batch by batch."""
    from ..streaming.jobs import diagnose_stream, file_stream

    m, root = _model(spark, sf, "stream_diagnosed"), Scratch(spark, "stream_diagnosed").root
    texts = file_stream(spark, f"{sf}/documents.parquet", table(spark, sf, "documents").schema)
    diagnose_stream(texts, lambda d: D.diagnose(d, "doc_id", F.col("text"), m), f"{root}/out", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("doc_id", "class", F.round("p", 9).alias("p"))
