"""Posts, dates, lexicon, ontology and span operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..operators import corpus as C
from ..operators import lexicon as L
from ..operators import ontology as O
from ..operators import posts as P
from ..operators import spans as SP
from ..operators import timestamps as TS
from ..sources import readers as R
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


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


#: subject lines of the documents' own posts, in the grammar of the mailing list
_SUBJ = "'PRO/EDR> ' || regexp_extract(text, 'Subject: (.*)', 1)"
_RX = P.SUBJECT.replace(r"(?: - (\w[\w\s]*?\w(?: \(\D[\D\s]*?\w\))?))?", r"(?: - ([\p{L}\p{N}_][\p{L}\p{N}_\s]*?[\p{L}\p{N}_](?: \([^0-9][^0-9]*?[\p{L}\p{N}_]\))?))?")


@query(rf"""WITH s AS (SELECT doc_id, {_SUBJ} AS s FROM documents WHERE regexp_extract(text, 'Subject: (.*)', 1) <> '')
SELECT doc_id, nullif(regexp_extract(s, '{_RX}', 1), '') AS ns1, nullif(regexp_extract(s, '{_RX}', 3), '') AS description, nullif(regexp_extract(s, '{_RX}', 4), '') AS region, try_cast(nullif(regexp_extract(s, '{_RX}', 5), '') AS BIGINT) AS thread_num, NOT regexp_matches(s, '{_RX}') AS is_malformed FROM s""")
def subject_parse(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.regexp_extract("text", "Subject: (.*)", 1).alias("s")).where("s <> ''")
    f = P.subject_fields(F.concat(F.lit("PRO/EDR> "), F.col("s")), _RX)
    return d.select("doc_id", *[f[c].alias(c) for c in ("ns1", "description", "region", "thread_num", "is_malformed")])


_LINE = "regexp_extract(text, 'Subject: (.*)', 1)"


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(s, '(?i)announcement') THEN 'announcement' END, CASE WHEN regexp_matches(s, '(?i)corr\.|correction') THEN 'correction' END, CASE WHEN regexp_matches(s, '(?i)\bRFI\b|request for information') THEN 'rfi' END,
CASE WHEN regexp_matches(s, '(?i)summary') THEN 'summary' END, CASE WHEN regexp_matches(s, '(?i)update') THEN 'update' END, CASE WHEN regexp_matches(coalesce(nullif(regexp_extract(s, '{_RX}', 3), ''), s), '(?i)((unknown|unidentified) (illness|disease))|undiagnosed') THEN 'undiagnosed' END], lambda x: x IS NOT NULL)), ' ') AS tags,
replace(replace(s, '&', 'and'), ',', '') AS simplified FROM (SELECT doc_id, split_part(text, chr(10), 1) AS s FROM documents WHERE text IS NOT NULL)""")
def subject_tags(spark, sf):
    """Tags of every document's first line, read as a subject."""
    s = F.split_part("text", F.lit("\n"), F.lit(1))
    d = _docs(spark, sf).where("text is not null").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.array_join(P.subject_tags(F.col("s"), P.subject_fields(F.col("s"), _RX)["description"]), " ").alias("tags"), P.simplified(F.col("s")).alias("simplified"))


@query(rf"""WITH s AS (SELECT doc_id, lower(replace(replace(coalesce(nullif(regexp_extract('PRO/EDR> ' || {_LINE}, '{_RX}', 3), ''), {_LINE}), '&', 'and'), ',', '')) AS s FROM documents WHERE {_LINE} <> ''),
l AS (SELECT row_no, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label FROM label_table WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> '')
SELECT DISTINCT doc_id, label, row_no FROM s, l WHERE regexp_matches(s, '\b' || regexp_escape(lower(replace(replace(label, '&', 'and'), ',', ''))) || '\b')""")
def subject_labels(spark, sf):
    """Labels of the table that stand as whole words in the description of a post's subject, with their places in the table."""
    d = _docs(spark, sf).select("doc_id", F.regexp_extract("text", "Subject: (.*)", 1).alias("s")).where("s <> ''")
    f = P.subject_fields(F.concat(F.lit("PRO/EDR> "), F.col("s")), _RX)
    labels = R.cleaned_labels(table(spark, sf, "label_table").select("row_no", "label"))
    return P.subject_labels(d, "doc_id", F.when(f["is_malformed"], F.col("s")).otherwise(f["description"]), labels, "label", "row_no")


@query(r"""SELECT doc_id, nullif(regexp_extract(text, 'Archive:\s(.*)', 1), '') AS archive, nullif(regexp_extract(text, 'Subject:\s(.*)', 1), '') AS subject, array_to_string(regexp_extract_all(text, '\d{4}\.\d+'), ' ') AS reports FROM documents WHERE text LIKE 'Subject:%'""")
def header_fields(spark, sf):
    t = F.col("text")
    d = _docs(spark, sf).where(t.startswith("Subject:"))
    return d.select("doc_id", P.header(t, "Archive").alias("archive"), P.header(t, "Subject").alias("subject"), F.array_join(F.regexp_extract_all(t, F.lit(r"\d{4}\.\d+"), F.lit(0)), " ").alias("reports"))


@query(r"""SELECT scrape_id, array_to_string(list_sort(list_distinct(regexp_extract_all(htmlcontent, 'http[^\s]+[^(.\])>\s]'))), ' ') AS links FROM scrape_result WHERE htmlcontent IS NOT NULL""")
def link_extract(spark, sf):
    return table(spark, sf, "scrape_result").where("htmlcontent is not null").select("scrape_id", F.array_join(P.links(F.col("htmlcontent")), " ").alias("links"))


@query(r"""SELECT doc_id, (i - 1)::BIGINT AS idx, md5(regexp_replace(s[i], '^\s+|\s+$', '', 'g')) AS section_md5 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '(?m)^[*#]{3,}[ \t\r\f]*$') AS s FROM documents WHERE text LIKE 'Subject:%'))""")
def section_split(spark, sf):
    s = P.sections(_docs(spark, sf).where(F.col("text").startswith("Subject:")), F.col("text"), "doc_id")
    return s.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.md5("section").alias("section_md5"))


@query()
def post_articles(spark, sf):
    """Articles of the posts (sections between lines of stars) with their fields."""
    d = _docs(spark, sf).where(F.col("text").startswith("Subject:")).select("doc_id", F.regexp_replace(P.without_comments(F.col("text")), r"(?m)^\[\d\] (\w+)$", "Source: $1\n").alias("t"))
    f = P.article_fields(F.col("section"))
    return P.articles(d, "doc_id", F.col("t")).select("doc_id", "article", *[v.alias(k) for k, v in f.items()])


@query("WITH " + instants_sql("SELECT item_id, meta.date AS t, NULL::VARCHAR AS tz FROM corpus_item") + " SELECT item_id, utc_us FROM instants")
def date_normalize(spark, sf):
    """All dates as written, zone-less ones read as UTC; null where they name no instant."""
    return TS.with_utc_micros(table(spark, sf, "corpus_item").select("item_id", F.col("meta.date").alias("t")).where("t is not null"), "t", None, "utc_us").select("item_id", "utc_us")


@query("""SELECT doc_id, (epoch_us(published) + CASE WHEN published > make_timestamp(year(published), 11, 1, 0, 0, 0) THEN 5 ELSE 4 END::BIGINT * 3600000000)::BIGINT AS utc_us FROM documents WHERE published IS NOT NULL""")
def publication_utc(spark, sf):
    """Publication times read as US Eastern."""
    d = _docs(spark, sf).where("published is not null").select("doc_id", F.date_format("published", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("p"))
    return d.select("doc_id", P.published(F.col("p")).alias("utc_us"))


@query("""SELECT doc_id, strftime(published, '%Y-%m-%dT%H:%M:%S') AS iso, year(published) AS y, month(published) AS m, day(published) AS d FROM documents WHERE published IS NOT NULL""")
def date_parts(spark, sf):
    p = F.col("published")
    return _docs(spark, sf).where("published is not null").select("doc_id", F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.year(p).cast("bigint").alias("y"), F.month(p).cast("bigint").alias("m"), F.dayofmonth(p).cast("bigint").alias("d"))


@query("""SELECT record_key, split_part(record_key, '.', 1) AS head, record_name FROM (SELECT id AS record_key, 'eha' || id AS record_name FROM curated_item GROUP BY id)""")
def record_names(spark, sf):
    d = table(spark, sf, "curated_item").select(F.col("id").alias("record_key")).distinct()
    return d.select("record_key", F.split_part("record_key", F.lit("."), F.lit(1)).alias("head"), X.record_name("eha", F.col("record_key")).alias("record_name"))


@query(r"""SELECT scrape_id, nullif(regexp_extract(sourceurl, '(id=|/post/)(\d+\.?\d*)', 2), '') AS post_id, nullif(regexp_extract(sourceurl, '[?&]ref=([^&#]*)', 1), '') AS ref FROM scrape_result WHERE sourceurl IS NOT NULL""")
def post_ids(spark, sf):
    """Post number and referrer in the links of the fetched pages."""
    u = F.col("sourceurl")
    return table(spark, sf, "scrape_result").where(u.isNotNull()).select("scrape_id", U.post_id(u).alias("post_id"), U.query_value(u, "ref").alias("ref"))


_CATS = "[" + ", ".join(f"'{c}'" for c in L.TRAINING_CATEGORIES) + "]"
_TYPES = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.TYPES.items()) + " END"
_LEX = """lex AS (SELECT row_no, regexp_replace(label, '^\\s+|\\s+$', '', 'g') AS keyword, CASE WHEN is_pathogen THEN 'wordnet/pathogens' WHEN is_category THEN 'eha/disease category' WHEN non_hm_label THEN 'usgs/unused' WHEN is_promed_label THEN 'pm/disease' ELSE 'hm/disease' END AS category FROM label_table WHERE regexp_replace(label, '^\\s+|\\s+$', '', 'g') <> '')"""


def _lexicon(spark, sf):
    c = F.when(F.col("is_pathogen"), "wordnet/pathogens").when(F.col("is_category"), "eha/disease category").when(F.col("non_hm_label"), "usgs/unused").when(F.col("is_promed_label"), "pm/disease").otherwise("hm/disease")
    return R.cleaned_labels(table(spark, sf, "label_table").select("row_no", "label", "is_pathogen", "is_category", "non_hm_label", "is_promed_label")).select("row_no", F.col("label").alias("keyword"), c.alias("category"))


@query(f"WITH {_LEX} SELECT row_no, keyword, category, {_TYPES} AS type, list_contains({_CATS}, category) AS trains FROM lex")
def lexicon_types(spark, sf):
    k = _lexicon(spark, sf)
    return k.select("row_no", "keyword", "category", L.keyword_type(F.col("category")).alias("type"), F.col("category").isin(L.TRAINING_CATEGORIES).alias("trains"))


@query(f"WITH {_LEX} SELECT DISTINCT category FROM lex WHERE NOT list_contains({_CATS}, category)")
def unused_categories(spark, sf):
    return L.unused_categories(_lexicon(spark, sf))


@query(f"WITH {_LEX}, t AS (SELECT {_TYPES} AS type, * FROM lex) SELECT type, lower(keyword) AS lowered, arg_max(keyword, row_no) AS keyword FROM t WHERE type IS NOT NULL GROUP BY 1, 2")
def lexicon_last_by_type(spark, sf):
    return L.last_by_type(_lexicon(spark, sf), "row_no")


@query(r"""SELECT row_no, CASE WHEN label IN ('can', 'don', 'dish', 'ad', 'mass', 'yellow', 'the', 'Consumption') THEN 'blocked' WHEN label IS NULL OR label = '' THEN 'empty' WHEN label <> regexp_replace(label, '^\s+|\s+$', '', 'g') THEN 'untrimmed' END AS problem, NOT contains(label, ' ') AND length(label) <= 6 AND upper(label) = label AS case_sensitive FROM label_table""")
def keyword_validate(spark, sf):
    """Every label as it stands in the table, judged as a keyword."""
    k = F.col("label")
    return table(spark, sf, "label_table").select("row_no", L.problem(k).alias("problem"), L.is_case_sensitive(k).alias("case_sensitive"))


@query(r"""WITH o AS (SELECT source, regexp_replace(lower(source), '[^a-z0-9_]', '', 'g') AS k FROM outlet), h AS (SELECT host, regexp_replace(lower(split_part(host, '.', 1)), '[^a-z0-9_]', '', 'g') AS k FROM outlet) SELECT source, host FROM o JOIN h USING (k)""")
def normalised_label_join(spark, sf):
    o = table(spark, sf, "outlet")
    h = o.select("host", F.split_part("host", F.lit("."), F.lit(1)).alias("h"))
    return O.normalised_join(o.select("source"), "source", h, "h", X.squashed_label).select("source", "host")


_SUFFIX = r"(?i)^(.+?)\s+\((" + "|".join(x.replace("-", r"\-") for x in O.NOTES + O.HOSTS) + r")\)"
_IS_HOST = "list_contains([" + ", ".join(f"'{h.lower()}'" for h in O.HOSTS) + "], lower(w))"


@query(rf"""SELECT row_no, CASE WHEN w <> '' THEN regexp_extract(label, '{_SUFFIX}', 1) ELSE label END AS base, CASE WHEN w <> '' AND NOT {_IS_HOST} THEN w END AS note, CASE WHEN {_IS_HOST} THEN w END AS host
FROM (SELECT row_no, label, regexp_extract(label, '{_SUFFIX}', 2) AS w FROM (SELECT row_no, label FROM label_table UNION ALL SELECT row_no, label || ' (' || source || ')' FROM label_table CROSS JOIN (VALUES ('avian'), ('Clinical'), ('Non-Human Primate')) v(source)) WHERE label IS NOT NULL)""")
def label_suffixes(spark, sf):
    """Labels without a bracket that names a note or host, and what it names; each label as it is, and with three brackets put behind it."""
    t = table(spark, sf, "label_table").where("label is not null").select("row_no", "label")
    more = t.select("row_no", F.explode(F.array(*[F.concat("label", F.lit(f" ({x})")) for x in ("avian", "Clinical", "Non-Human Primate")])).alias("label"))
    base, note, host = O.label_suffix(F.col("label"))
    return t.unionByName(more).select("row_no", base.alias("base"), note.alias("note"), host.alias("host"))


_DEFS = """('d1', 'A viral disease that has_symptom fever, has_symptom  the rash and transmitted_by ticks. It results_in coma.'), ('d2', 'located_in the liver or located_in lung, has_material_basis_in Yersinia pestis.')"""


@query("""SELECT * FROM (VALUES ('d1', 'has_symptom', 'fever'), ('d1', 'has_symptom', 'rash'), ('d1', 'transmitted_by', 'ticks'), ('d1', 'results_in', 'coma'), ('d2', 'located_in', 'liver'), ('d2', 'located_in', 'lung'), ('d2', 'has_material_basis_in', 'Yersinia pestis')) t(subject, relation, value)""")
def definition_relations(spark, sf):
    """On two definitions written here: no test table holds any."""
    return O.definition_relations(H.inline(spark, _DEFS, "subject, definition"), "subject", F.col("definition"))


@query(H.with_("SELECT DISTINCT label AS child, ancestor FROM walk WHERE label <> ancestor", H.LABELS))
def subclass_closure(spark, sf):
    """All ancestors over every path, cycles included, self-pairs left out."""
    s = Scratch(spark, "subclass_closure")
    e = H.label_edges(spark, sf, s).withColumnRenamed("label", "child")
    return O.closure(e, "child", "parent", s)


_ROOT = "(SELECT parent FROM own WHERE parent IS NOT NULL GROUP BY parent ORDER BY count(*) DESC, parent LIMIT 1)"


@query(H.with_(f"SELECT node, min(level)::INTEGER AS level FROM (SELECT {_ROOT} AS node, 0 AS level UNION ALL SELECT label, distance FROM walk WHERE ancestor = {_ROOT} AND distance <= 3) GROUP BY node", H.LABELS))
def hyponym_levels(spark, sf):
    """What lies up to three levels below the label with most children."""
    e = H.label_edges(spark, sf, Scratch(spark, "hyponym_levels"))
    top = e.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent").limit(1).select(F.col("parent").alias("node"))
    return O.levels(e, top, "node", "label", "parent")


@query(H.with_("SELECT DISTINCT a.label AS subject, 'kw ' || a.label AS keyword, 'kw ' || a.ancestor AS linked FROM walk a WHERE a.label <> a.ancestor", H.LABELS))
def linked_keywords(spark, sf):
    """Every label of a subject with every label of its ancestors."""
    s = Scratch(spark, "linked_keywords")
    e = H.label_edges(spark, sf, s)
    triples = e.select(F.col("label").alias("subject"), F.lit("label").alias("predicate"), F.concat(F.lit("kw "), "label").alias("object"))
    pairs = O.closure(e.withColumnRenamed("label", "subject"), "subject", "parent", s)
    return O.linked_labels(pairs, O.labels_of(triples))



@query(H.with_(f"""SELECT node, level::INTEGER AS level, replace(split_part(node, '.', 1), '_', ' ') AS lemma, array_to_string(list_transform(path, lambda x: replace(split_part(x, '.', 1), '_', ' ')), '|') AS ancestors
FROM (SELECT {_ROOT} AS node, 0 AS level, []::VARCHAR[] AS path UNION ALL SELECT * FROM w3)""", H.LABELS, f"w3 AS (SELECT label AS node, 1 AS level, [parent] AS path FROM edges WHERE parent = {_ROOT} UNION ALL SELECT e.label, w3.level + 1, list_prepend(e.parent, w3.path) FROM w3 JOIN edges e ON e.parent = w3.node WHERE w3.level < 3)"))
def hyponym_lemmas(spark, sf):
    """What lies up to three levels below the label with most children, with the lemmas of all that stand above it on the way."""
    e = H.label_edges(spark, sf, Scratch(spark, "hyponym_lemmas")).where("parent is not null")
    top = e.groupBy("parent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent").limit(1).select(F.col("parent").alias("node"))
    return O.hyponyms(e, top, X.lemma_name(F.col("node"))).select("node", "level", "lemma", F.array_join("ancestors", "|").alias("ancestors"))


@query(r"""WITH l AS (SELECT row_no, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, nullif(regexp_replace(synonym, '^\s+|\s+$', '', 'g'), '') AS synonym FROM label_table)
SELECT DISTINCT 'c' || a.row_no AS subject, a.label, b.synonym FROM l a LEFT JOIN l b ON b.row_no = a.row_no AND b.synonym IS NOT NULL WHERE a.label <> ''""")
def synonym_instances(spark, sf):
    """Labels of classes with their synonyms where they have any, from triples."""
    t = R.cleaned_labels(table(spark, sf, "label_table").select("row_no", "label", "synonym")).select(F.concat(F.lit("c"), "row_no").alias("subject"), "label", "synonym")
    triples = t.select("subject", F.lit("label").alias("predicate"), F.col("label").alias("object")).unionByName(t.where("synonym is not null").select("subject", F.lit("hasExactSynonym").alias("predicate"), F.col("synonym").alias("object")))
    return O.instances(triples)


def _spans(spark, sf, pattern):
    return SP.pattern_spans(_docs(spark, sf), "doc_id", F.col("text"), pattern)


_PLAIN_COUNT = r"[0-9]{1,7} (?:suspected cases|samples positive|deaths|new admissions|contacts)"
_PLAIN_DATE = rf"[0-9]{{1,2}} (?:{SP.MONTH})|(?:{SP.MONTH}) [0-9]{{1,2}}"


def _sql_spans(pattern: str, name: str) -> str:
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents WHERE text IS NOT NULL),
{name} AS (SELECT doc_id, m[i] AS label, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m))"""


@query(f"WITH {_sql_spans(_PLAIN_COUNT, 'c')} SELECT doc_id, s AS start, s + length(label) AS stop, label, regexp_extract(label, '^([0-9]+)', 1)::BIGINT AS value FROM c")
def count_spans(spark, sf):
    c = SP.count_features(_spans(spark, sf, _PLAIN_COUNT), "doc_id").where("type = 'count'")
    return c.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("stop"), "label", "value")


@query(f"WITH {_sql_spans(_PLAIN_DATE, 'd')} SELECT doc_id, label, array_to_string(list_transform(list_sort(list(DISTINCT s)), lambda x: x::VARCHAR), ' ') AS starts FROM d GROUP BY ALL")
def grouped_offsets(spark, sf):
    g = SP.grouped_offsets(_spans(spark, sf, _PLAIN_DATE), "doc_id", "label")
    return g.select("doc_id", "label", F.regexp_replace("offsets", r"-\d+", "").alias("starts"))


_NUMBER = r"[0-9]{1,7}"


@query(f"WITH {_sql_spans(_NUMBER, 'n')}, {_sql_spans(_PLAIN_DATE, 'd')} SELECT DISTINCT n.doc_id, n.s AS start, n.label FROM n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = n.doc_id AND n.s < d.s + length(d.label) AND d.s < n.s + length(n.label))")
def span_overlap_anti(spark, sf):
    """Numbers outside dates."""
    n = SP.without_overlaps(_spans(spark, sf, _NUMBER), _spans(spark, sf, _PLAIN_DATE), "doc_id")
    return n.select("doc_id", F.col("start").cast("bigint").alias("start"), "label").distinct()


def _keyword_spans(spark, sf, optimal=False):
    k = _lexicon(spark, sf).select(F.coalesce(L.keyword_type(F.col("category")), F.lit("other")).alias("type"), "keyword", L.is_case_sensitive(F.col("keyword")).alias("case_sensitive"))
    return SP.keyword_spans(_docs(spark, sf), "doc_id", F.col("text"), k, optimal)


_TOKEN_SQL = r"http\S*[\p{L}\p{N}_]|[\p{L}\p{N}_]+"
_KEYS = rf"""{_LEX}, ky AS (SELECT DISTINCT coalesce({_TYPES}, 'other') AS type, cs, array_to_string({H.sql_tokens("lower(keyword)")}, ' ') AS k, array_to_string({H.sql_tokens("keyword")}, ' ') AS raw, {H.sql_tokens("lower(keyword)")}[1] AS first, len({H.sql_tokens("keyword")}) AS n
  FROM (SELECT *, NOT contains(keyword, ' ') AND length(keyword) <= 6 AND upper(keyword) = keyword AS cs FROM lex) WHERE len({H.sql_tokens("keyword")}) BETWEEN 1 AND 5),
tk AS (SELECT doc_id, unnest(m) AS w, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN_SQL}') AS m, list_transform(regexp_split_to_array(text, '{_TOKEN_SQL}'), lambda x: length(x)) AS g FROM documents WHERE text IS NOT NULL)),
ts AS (SELECT doc_id, i, w, sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM tk),
tp AS (SELECT doc_id, w, stop - length(w) AS start, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS r, [stop, lead(stop, 1) OVER o, lead(stop, 2) OVER o, lead(stop, 3) OVER o, lead(stop, 4) OVER o] AS stops FROM ts WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ks AS (SELECT DISTINCT doc_id, type, start, stops[n] AS stop, CASE WHEN cs THEN raw ELSE k END AS label FROM tp JOIN ky ON lower(w) = first WHERE stops[n] IS NOT NULL AND lower(array_to_string(r[1:n], ' ')) = k AND (NOT cs OR array_to_string(r[1:n], ' ') = raw))"""


def _big(spans):
    return spans.select("doc_id", "type", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("stop"), "label")


@query(f"WITH {_KEYS} SELECT doc_id, type, start, stop, label FROM ks")
def keyword_spans(spark, sf):
    """Offsets of the lexicon's keywords, by annotation type."""
    return _big(_keyword_spans(spark, sf))


@query()
def optimal_spans(spark, sf):
    return _keyword_spans(spark, sf, True)


_DATES = rf"""{_sql_spans(SP.DATE, 'd')}, df AS (SELECT d.doc_id, d.s AS start, d.s + length(d.label) AS stop, d.label,
  try_strptime(regexp_extract(regexp_replace(d.label, '[12][0-9]{{3}}$', ''), '([0-9]{{1,2}})', 1) || ' ' || regexp_extract(d.label, '({SP.MONTH})', 1) || ' ' || coalesce(nullif(regexp_extract(d.label, '([12][0-9]{{3}})$', 1), ''), year(published)::VARCHAR), '%-d %B %Y')::DATE AS begin_day FROM d JOIN documents USING (doc_id))"""


def _dates(spark, sf):
    years = table(spark, sf, "documents").select("doc_id", F.year("published").alias("year"))
    return SP.date_features(_spans(spark, sf, SP.DATE), "doc_id", years)


@query(f"WITH {_DATES} SELECT doc_id, start, stop, label, strftime(begin_day, '%Y-%m-%d') AS begin_day, strftime(begin_day + 1, '%Y-%m-%d') AS end_day FROM df")
def date_features(spark, sf):
    """Dates in texts as ranges of one day; dates without a year are of the year of publication."""
    d = _dates(spark, sf)
    return d.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("stop"), "label", F.col("begin").cast("string").alias("begin_day"), F.col("stop").cast("string").alias("end_day"))


_COUNTS = rf"{_sql_spans(SP.COUNT, 'c')}"


@query(f"WITH {_COUNTS}, t AS (SELECT unnest(['count', 'caseCount']) AS type) SELECT doc_id, type, s AS start, s + length(label) AS stop, label, regexp_extract(label, '([0-9]+)', 1)::BIGINT AS value, NOT regexp_matches(label, '^[0-9]') AS cumulative FROM c, t WHERE type = 'count' OR contains(label, 'case')")
def count_features(spark, sf):
    """Counts of cases, deaths and the like, cumulative ones marked."""
    c = SP.count_features(_spans(spark, sf, SP.COUNT), "doc_id")
    return c.select("doc_id", "type", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("stop"), "label", "value", "cumulative")


_ORDER = "CASE type WHEN 'diseases' THEN 3 WHEN 'hosts' THEN 4 WHEN 'modes' THEN 5 WHEN 'pathogens' THEN 6 WHEN 'symptoms' THEN 7 ELSE 8 END"
_PLACES = rf"""pn AS (SELECT DISTINCT nullif(regexp_extract('PRO/EDR> ' || {_LINE}, '{_RX}', 4), '') AS name FROM documents WHERE {_LINE} <> ''),
pk AS (SELECT name, array_to_string({H.sql_tokens("lower(name)")}, ' ') AS k, {H.sql_tokens("lower(name)")}[1] AS first, len({H.sql_tokens("name")}) AS n FROM pn WHERE name IS NOT NULL AND len({H.sql_tokens("name")}) BETWEEN 1 AND 5),
ps AS (SELECT DISTINCT doc_id, start, stops[n] AS stop, name AS label FROM tp JOIN pk ON lower(w) = first WHERE stops[n] IS NOT NULL AND lower(array_to_string(r[1:n], ' ')) = k)"""


def _places(spark, sf, scratch):
    """(places, spans): the regions that posts name in their subjects, as a gazetteer, and where they stand in texts. The gazetteer is saved."""
    s = _docs(spark, sf).select(F.regexp_extract("text", "Subject: (.*)", 1).alias("s")).where("s <> ''")
    names = s.select(P.subject_fields(F.concat(F.lit("PRO/EDR> "), F.col("s")), _RX)["region"].alias("name")).where("name is not null").distinct()
    names = scratch.save(names)
    k = names.select(F.lit("place").alias("type"), F.col("name").alias("keyword"), F.lit(False).alias("case_sensitive"))
    return names, SP.keyword_spans(_docs(spark, sf), "doc_id", F.col("text"), k)


@query(f"WITH {_KEYS}, {_PLACES} SELECT doc_id, md5(label) AS geonameid, label AS name, array_to_string(list_transform(list_sort(list({{'s': start, 'e': stop}})), lambda x: x.s::VARCHAR || '-' || x.e::VARCHAR), ' ') AS offsets FROM ps GROUP BY ALL")
def location_features(spark, sf):
    """Places in texts, grouped by place; the gazetteer holds the regions of the posts' subjects."""
    names, spans = _places(spark, sf, Scratch(spark, "location_features"))
    return SP.location_features(spans, names.select(F.md5("name").alias("geonameid"), "name"), "doc_id")


@query(f"""WITH {_KEYS}, {_PLACES}, {_COUNTS}, {_DATES} SELECT doc_id, type, start, stop, label, 0::BIGINT AS place FROM (SELECT doc_id, unnest(CASE WHEN contains(label, 'case') THEN ['count', 'caseCount'] ELSE ['count'] END) AS type, s AS start, s + length(label) AS stop, label FROM c)
UNION ALL SELECT DISTINCT doc_id, 'location', start, stop, label, 1 FROM ps UNION ALL SELECT doc_id, 'datetime', start, stop, label, 2 FROM df
UNION ALL SELECT doc_id, type, start, stop, label, {_ORDER} FROM ks WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.doc_id = ks.doc_id AND ks.start < df.stop AND df.start < ks.stop)
UNION ALL SELECT doc_id, 'resolvedKeyword', start, stop, label, 9 FROM ks WHERE type = 'diseases' AND NOT EXISTS (SELECT 1 FROM ps WHERE ps.doc_id = ks.doc_id AND ks.start < ps.stop AND ps.start < ks.stop)""")
def annotation_features(spark, sf):
    """All features of a text in their fixed order: counts, places, dates, keywords by type (outside dates), resolved keywords (outside places).

    Spans that are met more than once are saved, small beside the texts: each pattern and lexicon reads the texts once."""
    s = Scratch(spark, "annotation_features")
    one = lambda d, kind, place: d.select("doc_id", kind.alias("type"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("stop"), "label", place.cast("bigint").alias("place"))
    c, d, k, (names, p) = SP.count_features(_spans(spark, sf, SP.COUNT), "doc_id"), s.save(_dates(spark, sf)), s.save(_keyword_spans(spark, sf)), _places(spark, sf, s)
    p = s.save(p.withColumn("k", F.col("label")).join(names.select(F.col("name"), X.normalised_keyword(F.col("name")).alias("k")), "k").withColumn("label", F.col("name")))
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in {"diseases": 3, "hosts": 4, "modes": 5, "pathogens": 6, "symptoms": 7}.items() for x in kv])[F.col("type")], F.lit(8))
    out = one(c, F.col("type"), F.lit(0)).unionByName(one(p, F.lit("location"), F.lit(1)).distinct()).unionByName(one(d, F.lit("datetime"), F.lit(2)))
    out = out.unionByName(one(SP.without_overlaps(k, d, "doc_id"), F.col("type"), order))
    return out.unionByName(one(SP.without_overlaps(k.where("type = 'diseases'"), p, "doc_id"), F.lit("resolvedKeyword"), F.lit(9)))


@query(f"""WITH {_KEYS}, {_PLACES}, {_COUNTS}, {_DATES}, dn AS (SELECT doc_id, start, strftime(begin_day, '%Y-%m-%d') AS begin_day FROM df), ds AS (SELECT doc_id, start, label AS disease FROM ks WHERE type = 'diseases'), pl AS (SELECT doc_id, start, label AS place FROM ps)
SELECT c.doc_id, c.s AS start, CASE WHEN contains(c.label, 'death') THEN 'deathCount' ELSE 'caseCount' END AS type, regexp_extract(c.label, '([0-9]+)', 1)::BIGINT AS value, n.begin_day, p.place, x.disease FROM c
LEFT JOIN (SELECT c.doc_id, c.s, arg_min(coalesce(o.begin_day, ''), (abs(o.start - c.s), o.start)) AS begin_day FROM c JOIN dn o ON o.doc_id = c.doc_id GROUP BY ALL) n ON n.doc_id = c.doc_id AND n.s = c.s
LEFT JOIN (SELECT c.doc_id, c.s, arg_min(o.place, (abs(o.start - c.s), o.start, o.place)) AS place FROM c JOIN pl o ON o.doc_id = c.doc_id GROUP BY ALL) p ON p.doc_id = c.doc_id AND p.s = c.s
LEFT JOIN (SELECT c.doc_id, c.s, arg_min(o.disease, (abs(o.start - c.s), o.start, o.disease)) AS disease FROM c JOIN ds o ON o.doc_id = c.doc_id GROUP BY ALL) x ON x.doc_id = c.doc_id AND x.s = c.s WHERE regexp_matches(c.label, 'case|death')""")
def incident_features(spark, sf):
    """Counts of cases and deaths with the nearest date, place and disease. Counts, met four times, are saved, as places are."""
    s = Scratch(spark, "incident_features")
    names, p = _places(spark, sf, s)
    p = p.withColumn("k", F.col("label")).join(names.select("name", X.normalised_keyword(F.col("name")).alias("k")), "k").select("doc_id", "start", F.col("name").alias("label"))
    dates = _dates(spark, sf).select("doc_id", "start", F.coalesce(F.col("begin").cast("string"), F.lit("")).alias("begin"), "stop")
    got = SP.incidents(s.save(SP.count_features(_spans(spark, sf, SP.COUNT), "doc_id")), dates, p, _keyword_spans(spark, sf).where("type = 'diseases'"), "doc_id")
    return got.select("doc_id", F.col("start").cast("bigint").alias("start"), "type", "value", F.col("begin").alias("begin_day"), "place", "disease")


@query(rf"""SELECT d.label AS disease, p.doc_id, row_number() OVER (PARTITION BY d.label ORDER BY p.published NULLS LAST, p.doc_id) AS nth FROM (SELECT DISTINCT regexp_replace(label, '^\s+|\s+$', '', 'g') AS label FROM label_table WHERE is_promed_label) d
JOIN (SELECT doc_id, published, lower(coalesce(nullif(regexp_extract('PRO/EDR> ' || {_LINE}, '{_RX}', 3), ''), {_LINE})) AS s FROM documents WHERE {_LINE} <> '' AND len(regexp_split_to_array(text, '(?m)^[*#]{{3,}}[ \t\r\f]*$')) > 1) p ON contains(s, lower(d.label)) WHERE d.label <> ''""")
def disease_posts(spark, sf):
    """Posts with articles whose subject's description holds the name of a list label, within each label by publication."""
    lab = R.cleaned_labels(table(spark, sf, "label_table").select("label", "is_promed_label")).where("is_promed_label").select(F.col("label").alias("disease"))
    subject = F.regexp_extract("text", "Subject: (.*)", 1)
    d = _docs(spark, sf).where((subject != "") & (F.size(F.split("text", P.SECTION)) > 1)).select("doc_id", "published", subject.alias("s"))
    f = P.subject_fields(F.concat(F.lit("PRO/EDR> "), F.col("s")), _RX)
    return P.posts_of(d, "doc_id", F.when(f["is_malformed"], F.col("s")).otherwise(f["description"]), lab, "disease", "published")


@query("""SELECT scrape_id, len(redirects)::BIGINT AS redirects, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM scrape_result WHERE url LIKE '%ref=%' OR len(redirects) > 0""")
def redirect_rows(spark, sf):
    s = table(spark, sf, "scrape_result").where("url like '%ref=%' or size(redirects) > 0")
    return s.select("scrape_id", F.when(F.col("redirects").isNotNull(), F.size("redirects")).cast("bigint").alias("redirects"), F.regexp_extract("url", "[?&]ref=([^&#]*)", 1).alias("ref"))


@query("""SELECT name, arg_max(item_id, item_id) AS newest, count(*)::BIGINT AS versions FROM corpus_item WHERE name IS NOT NULL GROUP BY name""")
def newest_versions(spark, sf):
    """Of rows stored again under a name, the newest and their number."""
    return table(spark, sf, "corpus_item").where("name is not null").groupBy("name").agg(F.max_by("item_id", "item_id").alias("newest"), F.count("*").alias("versions"))


@query("""SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE code >= 300)::BIGINT AS failed FROM (SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS source, code FROM scrape_result) GROUP BY source""")
def grouped_fetches(spark, sf):
    return table(spark, sf, "scrape_result").select(F.when(F.col("url").isNotNull(), F.coalesce(U.host(F.col("url")), F.lit(""))).alias("source"), "code").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("code") >= 300).alias("failed"))


@query("""SELECT item_id, position FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM corpus_item WHERE split = 'mixed_test') WHERE position < 100""")
def first_rows(spark, sf):
    got = C.first_rows(table(spark, sf, "corpus_item").where("split = 'mixed_test'").select("item_id"), 100, "item_id")
    return got.select("item_id", F.col("position").cast("bigint").alias("position"))


@query(f"WITH {_LEX}, t AS (SELECT {_TYPES} AS type, * FROM lex) SELECT DISTINCT type AS collection, keyword FROM t WHERE type IS NOT NULL")
def keyword_collections(spark, sf):
    """The lexicon, saved as one collection a type and read again; a keyword that repeats within one would be refused."""
    from ..sources import writers as W

    path = Scratch(spark, "keyword_collections").root
    W.save_collections(_lexicon(spark, sf).select("keyword", "category").withColumn("type", L.keyword_type(F.col("category"))).where("type is not null").dropDuplicates(["type", "keyword"]), path)
    return spark.read.parquet(path).select(F.col("collection").cast("string").alias("collection"), "keyword")


@query(r"""WITH l AS (SELECT row_no, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, nullif(regexp_replace(synonym, '^\s+|\s+$', '', 'g'), '') AS synonym FROM label_table WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> ''), q AS (SELECT lower(max(coalesce(synonym, label))) AS q FROM l)
SELECT DISTINCT row_no AS entity_id, label FROM l, q WHERE lower(label) = q.q OR lower(synonym) = q.q""")
def entity_lookups(spark, sf):
    """Entities with a synonym equal to the last one by name, in capitals."""
    t = R.cleaned_labels(table(spark, sf, "label_table").select("row_no", "label", "synonym"))
    e = t.select(F.col("row_no").alias("entity_id"), "label", F.lit("disease").alias("kind"))
    s = t.select(F.col("row_no").alias("entity_id"), F.explode(F.array_compact(F.array("label", "synonym"))).alias("synonym"))
    asked = t.agg(F.max(F.coalesce("synonym", "label"))).first()[0] or ""
    return R.entity_lookup(e, s, asked.upper()).select("entity_id", "label")


@query(r"""SELECT scrape_id, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path, url_decode(replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/', '%2F')) AS decoded FROM scrape_result WHERE url IS NOT NULL""")
def url_paths(spark, sf):
    """Paths of links, as they stand and with percent escapes read."""
    p = U.path(F.col("url"))
    return table(spark, sf, "scrape_result").where("url is not null").select("scrape_id", p.alias("path"), F.try_url_decode(F.replace(p, F.lit("/"), F.lit("%2F"))).alias("decoded"))


_SECTIONS = r"""sec AS (SELECT doc_id, i - 1 AS idx, regexp_replace(s[i], '^\s+|\s+$', '', 'g') AS section FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(?m)^\[\d\] (\w+)$', 'Source: \1' || chr(10), 'g'), '(?m)^[*#]{3,}[ \t\r\f]*$') AS s FROM documents WHERE text LIKE 'Subject:%')))"""
_NOTICE_SQL = P.NOTICE.replace("'", "''")


def _post_texts(spark, sf):
    return _docs(spark, sf).where(F.col("text").startswith("Subject:")).select("doc_id", F.regexp_replace("text", r"(?m)^\[\d\] (\w+)$", "Source: $1\n").alias("t"))


@query(rf"""WITH {_SECTIONS}, k AS (SELECT *, CASE WHEN regexp_matches(section, 'Source:\s[^\[\n]+(\s(\[.*))?\n') OR regexp_matches(section, '(?m)^Date:\s[^(\[\n]+') THEN 'article' WHEN regexp_matches(section, '{_NOTICE_SQL}') THEN 'notice' WHEN regexp_matches(section, '{P.CONTENTS}') THEN 'contents'
  WHEN regexp_matches(section, '{P.VARIOUS}') THEN 'various' WHEN section = '' THEN 'empty' WHEN idx = 0 AND length(section) - length(replace(section, chr(10), '')) < 2 THEN 'title' ELSE 'text' END AS kind FROM sec),
o AS (SELECT *, last_value(CASE WHEN kind <> 'text' THEN kind END IGNORE NULLS) OVER w AS open, count(*) FILTER (WHERE kind = 'article') OVER w AS article FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, (article - 1)::BIGINT AS article, md5(string_agg(section, chr(10) || '#####' || chr(10) ORDER BY idx)) AS article_md5 FROM o WHERE kind = 'article' OR kind = 'text' AND open = 'article' GROUP BY doc_id, article""")
def post_article_texts(spark, sf):
    """The articles of the posts, with the sections that continue them."""
    return P.articles(_post_texts(spark, sf), "doc_id", F.col("t")).select("doc_id", F.col("article").cast("bigint").alias("article"), F.md5("section").alias("article_md5"))


@query(rf"""WITH {_SECTIONS} SELECT doc_id, idx::BIGINT AS idx, nullif(regexp_extract(section, '(?m)^Date:\s([^(\[\n]+)', 1), '') AS date_text, nullif(regexp_extract(section, 'Source:\s([^\[\n]+)(?:\s(\[.*))?\n(http.+)?', 1), '') AS source_name,
nullif(regexp_extract(section, 'Source:\s([^\[\n]+)(?:\s(\[.*))?\n(http.+)?', 2), '') AS source_edits, nullif(regexp_extract(section, 'Source:\s([^\[\n]+)(?:\s(\[.*))?\n(http.+)?', 3), '') AS source_url FROM sec""")
def article_sources(spark, sf):
    """Date and source of every section of the posts."""
    f = P.article_fields(F.col("section"))
    return P.sections(_post_texts(spark, sf), F.col("t"), "doc_id").select("doc_id", F.col("idx").cast("bigint").alias("idx"), *[f[c].alias(c) for c in ("date_text", "source_name", "source_edits", "source_url")])


@query(r"""WITH c AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '(?s)\[.+?\]'), lambda x: regexp_matches(x, '-\s?Mod\.\s?(\w+)')) AS c FROM documents WHERE text LIKE 'Subject:%')
SELECT doc_id, len(c)::BIGINT AS comments, array_to_string(list_transform(c, lambda x: regexp_extract(x, '-\s?Mod\.\s?(\w+)', 1)), ' ') AS moderators, array_to_string(regexp_extract_all(text, '\d{8}\.\d+'), ' ') AS reports,
md5(list_reduce(list_prepend(text, c), lambda a, x: replace(a, x, ''))) AS text_md5 FROM c""")
def post_comments(spark, sf):
    """Moderators' comments and linked reports of the posts, and the texts without the comments."""
    t = F.col("text")
    m = P.moderator_comments(t)
    d = _docs(spark, sf).where(t.startswith("Subject:"))
    return d.select("doc_id", F.size(m).cast("bigint").alias("comments"), F.array_join(m["moderator"], " ").alias("moderators"), F.array_join(P.linked_reports(t), " ").alias("reports"), F.md5(P.without_comments(t)).alias("text_md5"))


@query(r"""SELECT scrape_id, CASE WHEN contains(h, 'news.google.com') THEN coalesce(nullif(regexp_extract(u, '[?&]url=([^&#]*)', 1), ''), u) ELSE u END AS target FROM (SELECT scrape_id, u, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS h
FROM (SELECT scrape_id, coalesce(redirects[len(redirects)].url, sourceurl) AS u FROM scrape_result)) WHERE u IS NOT NULL""")
def followed_links(spark, sf):
    """Where the links of the fetched pages lead in the end."""
    t = table(spark, sf, "scrape_result").select("scrape_id", U.followed(F.col("sourceurl"), F.col("redirects")).alias("target"))
    return t.where("target is not null")


_SYNSETS = r"""sy AS (SELECT row_no, list_filter([regexp_replace(label, '^\s+|\s+$', '', 'g'), nullif(regexp_replace(synonym, '^\s+|\s+$', '', 'g'), '')], lambda x: x IS NOT NULL AND x <> '' AND x NOT IN ('Fever', 'Plague')) AS synonyms, nullif(regexp_replace(parent_label, '^\s+|\s+$', '', 'g'), '') AS parent FROM label_table WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> '')"""


@query(rf"""WITH {_SYNSETS}, k AS (SELECT unnest(list_distinct(synonyms)) AS keyword, CASE WHEN parent IS NULL THEN '' ELSE '[linked] ' || parent END AS linked FROM sy)
SELECT keyword, linked, NOT contains(keyword, ' ') AND length(keyword) <= 6 AND upper(keyword) = keyword AS case_sensitive, row_number() OVER (PARTITION BY keyword ORDER BY linked) > 1 AS duplicate FROM k""")
def lexicon_build(spark, sf):
    """A lexicon of the label table's names and synonyms without excluded terms, linked to parents."""
    t = R.cleaned_labels(table(spark, sf, "label_table").select("label", "synonym", "parent_label"))
    synsets = t.select(F.array_compact(F.array("label", "synonym")).alias("synonyms"), F.array("parent_label").alias("parent_synonyms"), F.lit("hm/disease").alias("category"))
    built = L.checked(L.build(L.excluding(synsets, ["Fever", "Plague"], "synonyms")))
    return built.select("keyword", F.array_join("linked_keywords", "|").alias("linked"), "case_sensitive", "duplicate")


_DEEPEST = "(SELECT ancestor FROM anc ORDER BY distance DESC, ancestor LIMIT 1)"


@query(H.with_(f"SELECT DISTINCT w.label AS child, w.ancestor FROM walk w WHERE w.label <> w.ancestor AND w.label <> {_DEEPEST} AND w.ancestor <> {_DEEPEST} AND w.label IN (SELECT label FROM walk WHERE ancestor = {_DEEPEST}) AND w.ancestor IN (SELECT label FROM walk WHERE ancestor = {_DEEPEST})", H.LABELS))
def closure_within(spark, sf):
    """Ancestors of what lies below the label that stands highest above another, that label left out."""
    s = Scratch(spark, "closure_within")
    top = H.ancestors(spark, sf, s).orderBy(F.desc("distance"), "ancestor").first()
    pairs = O.closure(H.label_edges(spark, sf, s).withColumnRenamed("label", "child"), "child", "parent", s)
    return O.within(pairs, "child", top.ancestor) if top else pairs


def _post_date_sql() -> str:
    steps = [(r"\b\d{1,2}-(\d{1,2}\s\w{3,10}\s\d{4})\b", r"\1"), (r"CST(-?\d)CDT$", r"\1"), (r"(-\d{1,4})\s?[A-Z]{1,5}$", r"\1"), (r"\bTHURS?\b", "THURSDAY"), (r"\bTUES\b", "TUESDAY"), (r"\bWEDS\b", "WEDNESDAY"), (r"\bSEPT\b", "SEPTEMBER"),
             (r"^(?:MON|TUES|WEDNES|THURS|FRI|SATUR|SUN)DAY\.?,?\s+", "")]
    x = r"upper(regexp_replace(meta.date, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
    for rx, to in steps:
        x = f"regexp_replace({x}, '{rx}', '{to}', 'g')"
    bad = rf"regexp_matches(s, '-\d{{3}}(\d{{2,}})?$') OR regexp_matches(s, '\s:')"
    hours = r"regexp_replace(regexp_replace(s, ' (-?)(\d)$', ' GMT\1\2'), ' GMT(\d)$', ' GMT+\1')"
    return f"SELECT item_id, CASE WHEN NOT ({bad}) THEN {hours} END AS t, NULL::VARCHAR AS tz FROM (SELECT item_id, meta, {x} AS s FROM corpus_item)"


@query("WITH " + instants_sql(_post_date_sql()) + " SELECT i.item_id, utc_us FROM corpus_item i LEFT JOIN instants USING (item_id) WHERE i.meta.date IS NOT NULL")
def post_dates(spark, sf):
    """All dates read by the rules for the date lines of posts."""
    return table(spark, sf, "corpus_item").where("meta.date is not null").select("item_id", P.parsed_date(F.col("meta.date")).alias("utc_us"))
