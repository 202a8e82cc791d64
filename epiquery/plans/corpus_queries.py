"""Labels, corpus building and evaluation over the stored items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import evaluate as V
from ..operators import features as FE
from ..operators import timestamps as TS
from ..functions import text as X
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


def _items(spark, sf):
    return table(spark, sf, "corpus_item")


_FLAGS = ", ".join(R.LABEL_FLAGS)


@query(rf"""SELECT row_no, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, nullif(regexp_replace(parent_label, '^\s+|\s+$', '', 'g'), '') AS parent_label, nullif(regexp_replace(synonym, '^\s+|\s+$', '', 'g'), '') AS synonym, {_FLAGS}
FROM label_table WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> ''""")
def label_clean(spark, sf):
    return R.cleaned_labels(table(spark, sf, "label_table").select("row_no", "label", "parent_label", "synonym", *[F.col(c) for c in R.LABEL_FLAGS]))


@query(r"""SELECT label, first_not_disease OR first_not_human AS not_human FROM (SELECT label, arg_min(coalesce(is_not_disease, false), row_no) AS first_not_disease, arg_min(coalesce(not_human_disease, false), row_no) AS first_not_human
FROM (SELECT row_no, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, is_not_disease, not_human_disease FROM label_table) WHERE label <> '' GROUP BY label)""")
def label_predicates(spark, sf):
    """Whether a label is no human disease: its first row says that it is no disease, or that it is none of humans. All labels of the table."""
    return R.not_human(label_clean(spark, sf))


@query(H.with_("SELECT label, ancestor FROM anc", H.LABELS))
def label_closure(spark, sf):
    """Labels that each label implies; a label on a cycle implies itself."""
    return H.ancestors(spark, sf, Scratch(spark, "label_closure")).select("label", "ancestor")


_DIS = "flatten(list_transform(meta.events, lambda e: coalesce(e.diseases, [])))"
_KNOWN = "(SELECT DISTINCT regexp_replace(label, '^\\s+|\\s+$', '', 'g') AS label FROM label_table WHERE label IS NOT NULL)"


@query(f"""WITH d AS (SELECT item_id, coalesce({_DIS}, []) AS ds FROM corpus_item), b AS (SELECT DISTINCT item_id FROM (SELECT item_id, unnest(ds) AS x FROM d) LEFT JOIN {_KNOWN} k ON k.label = x WHERE k.label IS NULL),
o AS (SELECT d.item_id, b.item_id IS NOT NULL AS bad, list_sort(list_distinct(list_filter(ds, lambda x: x IS NOT NULL))) AS labels FROM d LEFT JOIN b USING (item_id))
SELECT item_id, array_to_string(labels, '|') AS labels, CASE WHEN bad THEN 'unknown label' WHEN len(labels) = 0 THEN 'no label' END AS reason FROM o""")
def item_accept(spark, sf):
    known = label_clean(spark, sf).select("label")
    got = C.accepted(_items(spark, sf).select("item_id", "name", "meta"), F.col("name"), H.diseases(), known, "label")
    return got.select("item_id", F.array_join("labels", "|").alias("labels"), "reason")


@query("""SELECT item_id FROM corpus_item WHERE private.cleancontent.content IS NOT NULL AND private.cleancontent.malformed IS DISTINCT FROM true AND private.cleancontent.clearnerversion = '0.0.0'
AND (private.englishtranslation IS NULL OR private.englishtranslation.content IS NOT NULL) AND meta.events IS NOT NULL AND private.scrapeddata.scraperversion = '0.0.3' AND private.scrapeddata.unscrapable IS DISTINCT FROM true
AND private.scrapeddata.url IS NOT NULL AND length(private.scrapeddata.sourceurl) < length(private.scrapeddata.url) + 12""")
def corpus_predicate(spark, sf):
    return _items(spark, sf).where(C.is_usable()).select("item_id")


@query("""SELECT item_id, CASE WHEN received_at BETWEEN TIMESTAMP '2013-01-08 00:09:12' AND TIMESTAMP '2013-01-08 00:09:12' + INTERVAL 180 DAY THEN 'test' WHEN received_at > TIMESTAMP '2013-01-08 00:09:12' + INTERVAL 210 DAY THEN 'rest' END AS part FROM corpus_item""")
def date_split(spark, sf):
    return _items(spark, sf).select("item_id", C.date_split(F.col("received_at").cast("timestamp_ntz")).alias("part"))


_NUM = r"try_cast(nullif(regexp_extract(regexp_replace(name, '^\s+|\s+$', '', 'g'), '^(\d+)\d{4}$', 1), '') AS BIGINT)"


@query(rf"""WITH n AS (SELECT item_id, {_NUM} AS k FROM corpus_item), t AS (SELECT least(1.0, 18000.0 / count(k)) AS u FROM n)
SELECT item_id, CASE WHEN k % 10 = 9 THEN 'mixed_test' WHEN k % 10 < floor(u * 10) THEN 'training' END AS part FROM n, t""")
def modular_split(spark, sf):
    """By the last digit of the article's number, which is its name without the last four characters."""
    k = F.regexp_extract(X.trim(F.col("name")), r"^(\d+)\d{4}$", 1)
    d = _items(spark, sf).select("item_id", F.when(k != "", k).cast("bigint").alias("k"))
    return d.select("item_id", C.modular_split(F.col("k"), d.where("k is not null").count()).alias("part"))


@query("""WITH c AS (SELECT label, id FROM (SELECT id, unnest(labels) AS label FROM curated_item) WHERE label IS NOT NULL GROUP BY ALL), t AS (SELECT id, min(md5(content)) AS k FROM curated_item GROUP BY id),
r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY k NULLS LAST, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM c JOIN t USING (id))
SELECT label, id, CASE WHEN n >= 10 AND rn <= 5 THEN 'test' ELSE 'training' END AS split FROM r""")
def earliest_split_by_key(spark, sf):
    """The split of labels with ten or more items, by an ordering key that SQL has too."""
    c = table(spark, sf, "curated_item")
    k = c.groupBy("id").agg(F.min(F.md5("content")).alias("k"))
    rows = c.select("id", F.explode("labels").alias("label")).where("label is not null").distinct().join(k, "id")
    return C.earliest_split(rows, "label", "k", "id").select("label", "id", "split")


@query("WITH " + instants_sql("SELECT DISTINCT id, created AS t, curator_tz AS tz FROM curated_item") + """, c AS (SELECT DISTINCT label, id FROM (SELECT id, unnest(labels) AS label FROM curated_item) WHERE label IS NOT NULL), t AS (SELECT i.id, min(utc_us) AS us FROM curated_item i LEFT JOIN instants USING (id) GROUP BY i.id),
r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY us NULLS LAST, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM c JOIN t USING (id)) SELECT label, id, CASE WHEN n >= 10 AND rn <= 5 THEN 'test' ELSE 'training' END AS split FROM r""")
def earliest_split(spark, sf):
    """As above by the instant of creation: the five earliest items of a label with ten or more are test items."""
    c = TS.with_utc_micros(table(spark, sf, "curated_item"), "created", "curator_tz", "us")
    k = c.groupBy("id").agg(F.min("us").alias("us"))
    rows = c.select("id", F.explode("labels").alias("label")).where("label is not null").distinct().join(k, "id")
    return C.earliest_split(rows, "label", "us", "id").select("label", "id", "split")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY published NULLS LAST, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL)
SELECT source, doc_id, CASE WHEN n >= 10 AND rn <= 5 THEN 'test' ELSE 'training' END AS split FROM r""")
def earliest_split_by_time(spark, sf):
    """The five earliest documents of a source with ten or more are test documents."""
    d = table(spark, sf, "documents").where("source is not null").select("source", "published", "doc_id")
    return C.earliest_split(d, "source", "published", "doc_id").select("source", "doc_id", "split")


@query("""WITH f AS (SELECT name, min(item_id) AS item_id FROM corpus_item GROUP BY name), e AS (SELECT name, list_sort(list(DISTINCT l) FILTER (WHERE l IS NOT NULL)) AS l FROM (SELECT name, unnest(meta.events[1].diseases) AS l FROM corpus_item) GROUP BY name)
SELECT c.name, c.item_id, c.split, c.source, c.meta.date AS date, len(c.meta.events)::BIGINT AS events, CASE WHEN len(c.meta.events) > 0 THEN array_to_string(coalesce(e.l, []), '|') ELSE '' END AS labels FROM f JOIN corpus_item c ON c.item_id = f.item_id LEFT JOIN e ON e.name IS NOT DISTINCT FROM c.name""")
def dedup_merge(spark, sf):
    """One item a name: the first, with the diseases of the first event of all items of the name as those of its first event; a first item
    without any event has none to hold them (the original fails there)."""
    got = C.merged_duplicates(_items(spark, sf).select("item_id", "name", "split", "source", "meta"), "name", "item_id", "meta")
    labels = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.get("meta.events", F.lit(0))["diseases"], F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return got.select("name", "item_id", "split", "source", F.col("meta.date").alias("date"), F.when(F.col("meta.events").isNotNull(), F.size("meta.events")).cast("bigint").alias("events"), F.array_join(labels, "|").alias("labels"))


@query("""SELECT item_id, name FROM corpus_item WHERE split IN ('mixed_test', 'time_offset_test') AND (name IS NULL OR name NOT IN (SELECT name FROM corpus_item WHERE split = 'training' AND name IS NOT NULL))""")
def train_test_anti(spark, sf):
    i = _items(spark, sf)
    return C.not_in(i.where("split in ('mixed_test', 'time_offset_test')").select("item_id", "name"), i.where("split = 'training'"), "name")


_LC = f"""o AS (SELECT DISTINCT item_id, l AS label FROM (SELECT item_id, unnest({_DIS}) AS l FROM corpus_item) WHERE l IS NOT NULL)"""


@query(H.with_("SELECT label, count(*)::BIGINT AS n FROM (SELECT * FROM o UNION SELECT item_id, ancestor FROM o JOIN anc USING (label)) GROUP BY label", H.LABELS, _LC))
def label_counts(spark, sf):
    up = H.ancestors(spark, sf, Scratch(spark, "label_counts"))
    return C.label_counts(_items(spark, sf), "item_id", H.diseases(), up)


@query(H.with_("SELECT item_id, label, false AS inferred FROM o UNION ALL (SELECT item_id, ancestor, true FROM o JOIN anc USING (label) EXCEPT SELECT item_id, label, true FROM o)", H.LABELS, _LC))
def lift_labels(spark, sf):
    """Items' labels with the ancestors they imply."""
    up = H.ancestors(spark, sf, Scratch(spark, "lift_labels"))
    o = _items(spark, sf).select("item_id", F.explode(H.diseases()).alias("label")).where("label is not null").distinct()
    more = o.join(up, "label").select("item_id", F.col("ancestor").alias("label")).distinct().join(o, ["item_id", "label"], "left_anti")
    return o.withColumn("inferred", F.lit(False)).unionByName(more.withColumn("inferred", F.lit(True)))


_TOK = f"SELECT DISTINCT unnest({H.sql_tokens('lower(text)')}) AS token FROM documents WHERE lang = '%s'"


def _tokens(spark, sf):
    d = table(spark, sf, "documents").where("lang in ('pt', 'es')").select("lang", F.explode(X.tokens(F.col("text"))).alias("token"))
    return C.compared(d, "token", F.col("lang") == "pt", F.col("lang") == "es")


@query(f"({_TOK % 'pt'}) EXCEPT ({_TOK % 'es'})")
def feature_diff(spark, sf):
    """Tokens of the texts labelled pt that none labelled es has."""
    return _tokens(spark, sf).where("in_left and not in_right").select("token")


@query(f"({_TOK % 'pt'}) INTERSECT ({_TOK % 'es'})")
def keyword_intersect(spark, sf):
    """Tokens that both have."""
    return _tokens(spark, sf).where("in_left and in_right").select("token")


@query("""SELECT 'documents' AS origin, source, count(*)::BIGINT AS n FROM documents GROUP BY ALL UNION ALL SELECT 'corpus_item', source, count(*) FROM corpus_item GROUP BY ALL UNION ALL SELECT 'curated_item', NULL, count(*) FROM curated_item""")
def union_sources(spark, sf):
    a = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), "source")
    b = table(spark, sf, "corpus_item").select(F.lit("corpus_item").alias("origin"), "source")
    c = table(spark, sf, "curated_item").select(F.lit("curated_item").alias("origin"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True).groupBy("origin", "source").agg(F.count("*").alias("n"))


# Truth: an item's labels with their ancestors. Prediction: the labels whose name stands in its text.
_PR = rf"""tr AS (SELECT * FROM o UNION SELECT item_id, ancestor FROM o JOIN anc USING (label)),
kt2 AS (SELECT label, {H.sql_tokens('lower(label)')} AS t FROM edges), kk AS (SELECT label, array_to_string(t, ' ') AS keyword, t[1] AS first, len(t) AS n FROM kt2 WHERE len(t) BETWEEN 1 AND 5),
it AS (SELECT item_id, {H.sql_tokens('lower(private.cleancontent.content)')} AS toks FROM corpus_item WHERE private.cleancontent.content IS NOT NULL), ip AS (SELECT item_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM it),
pd AS (SELECT DISTINCT item_id, label FROM ip JOIN kk ON toks[pos] = first AND array_to_string(toks[pos:pos + n - 1], ' ') = keyword),
c AS (SELECT coalesce(tr.label, pd.label) AS label, count(*) FILTER (WHERE tr.label IS NOT NULL AND pd.label IS NOT NULL)::BIGINT AS tp, count(*) FILTER (WHERE tr.label IS NULL)::BIGINT AS fp, count(*) FILTER (WHERE pd.label IS NULL)::BIGINT AS fn FROM tr FULL JOIN pd ON tr.item_id = pd.item_id AND tr.label = pd.label GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f FROM c)"""


def _evaluated(spark, sf, name):
    s = Scratch(spark, name)
    m = H.model(spark, sf, s)
    up, edges = m.pairs, m.edges
    o = _items(spark, sf).select("item_id", F.explode(H.diseases()).alias("label")).where("label is not null").distinct()
    truth = o.unionByName(o.join(up, "label").select("item_id", F.col("ancestor").alias("label"))).distinct()
    k = edges.select("label", X.normalised_keyword(F.col("label")).alias("keyword"))
    got = FE.keyword_counts(spread(_items(spark, sf)), "item_id", F.col("private.cleancontent.content"), edges, "label")
    return truth, got.join(k, "keyword").select("item_id", "label").distinct()


@query(H.with_("SELECT label, tp, fp, fn, tp + fn AS support, round(pr, 9) AS precision, round(re, 9) AS recall, round(f, 9) AS f FROM m", H.LABELS, _LC, _PR))
def prf_label(spark, sf):
    got = V.by_label(*_evaluated(spark, sf, "prf_label"), "item_id")
    return got.select("label", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


@query(H.with_("SELECT label, round(f, 9) AS f, row_number() OVER (ORDER BY f, label) AS place FROM m", H.LABELS, _LC, _PR))
def prf_weakest(spark, sf):
    """Labels by F-score, the weakest first."""
    return V.weakest_first(V.by_label(*_evaluated(spark, sf, "prf_weakest"), "item_id")).select("label", F.round("f", 9).alias("f"), "place")


@query(H.with_("SELECT round(avg(pr), 9) AS precision, round(avg(re), 9) AS recall, round(avg(f), 9) AS f, count(*)::BIGINT AS labels FROM m", H.LABELS, _LC, _PR))
def prf_macro(spark, sf):
    got = V.macro(V.by_label(*_evaluated(spark, sf, "prf_macro"), "item_id"))
    return got.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")], "labels")


@query(H.with_("SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 9) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f FROM m", H.LABELS, _LC, _PR))
def prf_micro(spark, sf):
    got = V.micro(V.by_label(*_evaluated(spark, sf, "prf_micro"), "item_id"))
    return got.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


@query(H.with_("""SELECT d.item_id, coalesce(t.l, '') AS truth, coalesce(q.l, '') AS predicted FROM (SELECT DISTINCT item_id FROM tr ORDER BY item_id LIMIT 100) d LEFT JOIN (SELECT item_id, array_to_string(list_sort(list(label)), '|') AS l FROM tr GROUP BY 1) t USING (item_id)
LEFT JOIN (SELECT item_id, array_to_string(list_sort(list(label)), '|') AS l FROM pd GROUP BY 1) q USING (item_id) WHERE coalesce(t.l, '') <> coalesce(q.l, '')""", H.LABELS, _LC, _PR))
def misclassified(spark, sf):
    return V.misclassified(*_evaluated(spark, sf, "misclassified"), "item_id")


@query(H.with_(f"""SELECT reason, count(*)::BIGINT AS items, count(*) FILTER (WHERE hit)::BIGINT AS with_features FROM (SELECT CASE WHEN bad THEN 'unknown label' WHEN len(labels) = 0 THEN 'no label' ELSE 'accepted' END AS reason, f.item_id IS NOT NULL AS hit
FROM (SELECT d.item_id, b.item_id IS NOT NULL AS bad, list_filter(ds, lambda x: x IS NOT NULL) AS labels FROM (SELECT item_id, coalesce({_DIS}, []) AS ds FROM corpus_item) d LEFT JOIN (SELECT DISTINCT item_id FROM (SELECT item_id, unnest(coalesce({_DIS}, [])) AS x FROM corpus_item) LEFT JOIN {_KNOWN} k ON k.label = x WHERE k.label IS NULL) b USING (item_id)) o
LEFT JOIN (SELECT DISTINCT item_id FROM pd) f USING (item_id)) GROUP BY reason""", H.LABELS, _LC, _PR))
def corpus_report(spark, sf):
    """Items accepted and rejected, by reason, and how many of them have any feature."""
    known = label_clean(spark, sf).select("label")
    got = C.accepted(_items(spark, sf).select("item_id", "name", "meta"), F.col("name"), H.diseases(), known, "label").select("item_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))
    m = H.model(spark, sf, Scratch(spark, "corpus_report"))
    some = m.base(spread(_items(spark, sf)), "item_id", F.col("private.cleancontent.content")).select("item_id").distinct().withColumn("hit", F.lit(True))
    return got.join(some, "item_id", "left").groupBy("reason").agg(F.count("*").alias("items"), F.count("hit").alias("with_features"))


def _trained(spark, sf, scratch, features=None):
    """A model trained on the usable training items, or on their features, saved as the next version of an artifact, and loaded from there."""
    from ..operators import train as TR
    from ..storage import checkpoint_dir

    t = _items(spark, sf)
    return TR.trained_model(table(spark, sf, "label_table"), t.where(C.is_usable() & (F.col("split") == "training")), "item_id", F.col("private.cleancontent.content"), H.diseases(), f"{checkpoint_dir(spark)}/models", scratch, features)


@query()
def diagnose_trained(spark, sf):
    """Ranked labels of the documents: trained on the items, saved, loaded, then scored with the learned coefficients."""
    from ..operators import diagnose as D

    s = Scratch(spark, "diagnose_trained")
    got = D.diagnose(spread(table(spark, sf, "documents")), "doc_id", F.col("text"), _trained(spark, sf, s))
    return D.ranked(got, "doc_id").withColumn("p", F.round("p", 6))


@query()
def evaluation_sets(spark, sf):
    """Scores of the trained model over the three splits: macro and micro. Truth counts with its implied labels.

    The training items are among those evaluated, so the texts are read once, for the features of both."""
    from ..operators import service as SV

    s = Scratch(spark, "evaluation_sets")
    usable, text = _items(spark, sf).where(C.is_usable() & F.col("split").isNotNull()), F.col("private.cleancontent.content")
    m, key = H.model(spark, sf, s), F.struct("item_id", "split").alias("item")
    f = m.features(m.base(spread(usable.select(key, "private")), "item", text), "item").select("item.item_id", "item.split", "feature", "value")
    m = _trained(spark, sf, s, f.where("split = 'training'").drop("split"))
    return SV.evaluate(m, usable, "item_id", text, H.diseases(), "split", f.drop("split"))


@query(r"""SELECT row_no, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, nullif(regexp_replace(parent_label, '^\s+|\s+$', '', 'g'), '') AS parent_label, nullif(regexp_replace(synonym, '^\s+|\s+$', '', 'g'), '') AS synonym FROM label_table WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> ''""")
def labels_saved_and_loaded(spark, sf):
    """The cleaned label table, saved as the next version of an artifact and loaded again as the newest."""
    from ..sources import artifacts as A
    from ..storage import checkpoint_dir

    folder = f"{checkpoint_dir(spark)}/lexicons"
    A.save(label_clean(spark, sf).select("row_no", "label", "parent_label", "synonym"), folder, "labels-")
    return A.load(spark, folder, "labels-")


@query()
def train_ovr(spark, sf):
    """Coefficients of one logistic regression a label, trained on the usable training items' keyword features."""
    from ..operators import diagnose as D
    from ..operators import train as TR

    s = Scratch(spark, "train_ovr")
    m = D.LabelModel(table(spark, sf, "label_table"), s)
    i = _items(spark, sf).where(C.is_usable() & (F.col("split") == "training"))
    f = m.features(m.base(i, "item_id", F.col("private.cleancontent.content")), "item_id")
    labels = i.select("item_id", F.explode(H.diseases()).alias("label")).where("label is not null")
    return TR.one_vs_rest(f, labels, "item_id", s)[0]


def _folder(spark, name: str) -> str:
    return Scratch(spark, name).root


@query(rf"""SELECT regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, nullif(regexp_replace(parent_label, '^\s+|\s+$', '', 'g'), '') AS parent_label, {_FLAGS} FROM label_table WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> ''""")
def label_csv_scan(spark, sf):
    """The label table, written as the CSV file it comes as and read again."""
    path = _folder(spark, "label_csv_scan")
    names = [c.split()[0] for c in R.LABEL_COLUMNS.split(", ")]
    t = table(spark, sf, "label_table").select(*[F.upper(F.col(c).cast("string")).alias(c) if c in R.LABEL_FLAGS else F.col(c) for c in names])
    t.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.label_csv(spark, path).select("label", "parent_label", *R.LABEL_FLAGS)


@query(r"""SELECT DISTINCT regexp_replace(label, '^\s+|\s+$', '', 'g') AS label FROM label_table WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> ''""")
def label_list_scan(spark, sf):
    """The labels as a YAML list."""
    path = _folder(spark, "label_list_scan")
    label_clean(spark, sf).select(F.concat(F.lit("- "), "label").alias("value")).distinct().write.text(path)
    return R.label_list(spark, path).select(X.trim(F.col("label")).alias("label"))


@query("""SELECT name, meta.date AS date, len(meta.events)::BIGINT AS events, md5(private.cleancontent.content) AS content_md5, private.scrapeddata.url AS url FROM corpus_item""")
def corpus_json_scan(spark, sf):
    """The stored items as JSON lines."""
    path = _folder(spark, "corpus_json_scan")
    _items(spark, sf).select("name", "meta", "private").write.json(path)
    size = F.when(F.col("meta.events").isNotNull(), F.size("meta.events")).cast("bigint")
    return R.corpus_items(spark, path).select("name", F.col("meta.date").alias("date"), size.alias("events"), F.md5("private.cleancontent.content").alias("content_md5"), F.col("private.scrapeddata.url").alias("url"))


_TRIPLES = r"""SELECT 'c' || row_no AS subject, p AS predicate, CASE p WHEN 'label' THEN label WHEN 'hasExactSynonym' THEN synonym ELSE 'p ' || parent END AS object FROM (SELECT row_no, regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, nullif(regexp_replace(synonym, '^\s+|\s+$', '', 'g'), '') AS synonym,
nullif(regexp_replace(parent_label, '^\s+|\s+$', '', 'g'), '') AS parent FROM label_table), (SELECT unnest(['label', 'hasExactSynonym', 'note']) AS p) WHERE label <> '' AND CASE p WHEN 'label' THEN label WHEN 'hasExactSynonym' THEN synonym ELSE parent END IS NOT NULL"""


def _class_lines(spark, sf):
    t = R.cleaned_labels(table(spark, sf, "label_table").select("row_no", "label", "synonym", "parent_label"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return t.select(F.concat(F.lit("http://x.org/o#c"), "row_no").alias("s"), quoted(F.col("label")).alias("label"), quoted(F.col("synonym")).alias("synonym"), quoted(F.concat(F.lit("p "), "parent_label")).alias("parent"))


@query(_TRIPLES)
def triples_scan(spark, sf):
    """The label table as N-Triples, one statement a line."""
    path = _folder(spark, "triples_scan")
    c = _class_lines(spark, sf)
    line = lambda p, o: F.when(F.col(o).isNotNull(), F.concat(F.lit("<"), "s", F.lit(f"> <http://x.org/o#{p}> "), o, F.lit("@en .")))
    c.select(F.explode(F.array_compact(F.array(line("label", "label"), line("hasExactSynonym", "synonym"), line("note", "parent")))).alias("value")).write.text(path)
    return R.rdf_triples(spark, path).select("subject", "predicate", F.regexp_replace(F.regexp_replace("object", r'\\"', '"'), r"\\\\", r"\\").alias("object"))


@query(_TRIPLES)
def turtle_scan(spark, sf):
    """The label table as Turtle files with a prefix and lists of predicates."""
    path = _folder(spark, "turtle_scan")
    c = _class_lines(spark, sf)
    more = lambda p, o: F.when(F.col(o).isNotNull(), F.concat(F.lit(f" ;\n  o:{p} "), o)).otherwise("")
    c.select(F.concat(F.lit("@prefix o: <http://x.org/o#> .\n<"), "s", F.lit("> o:label "), "label", F.lit("@en"), more("hasExactSynonym", "synonym"), more("note", "parent"), F.lit(" .")).alias("value")).write.text(path)
    return R.turtle_triples(spark, path)


@query(r"""SELECT row_no, regexp_replace(label || ' (disorder)', '\s\((disorder|(morphologic abnormality)|finding)?\)', '', 'g') AS plain, replace(split_part(label, '.', 1), '_', ' ') AS lemma, array_to_string(list_filter(list_transform(string_split(replace(label, ' ', '/'), '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts,
is_pathogen AS pathogen FROM label_table WHERE label IS NOT NULL""")
def label_strings(spark, sf):
    """Labels without a qualifier, as a lemma's name, in parts, and a flag read from text."""
    t = table(spark, sf, "label_table").where("label is not null")
    c = F.col("label")
    return t.select("row_no", X.without_qualifier(F.concat(c, F.lit(" (disorder)"))).alias("plain"), X.lemma_name(c).alias("lemma"), F.array_join(X.split_trimmed(F.replace(c, F.lit(" "), F.lit("/")), "/"), "|").alias("parts"), X.bool_argument(F.upper(F.col("is_pathogen").cast("string"))).alias("pathogen"))


@query("""SELECT DISTINCT regexp_replace(label, '^\\s+|\\s+$', '', 'g') AS _id FROM label_table WHERE regexp_replace(label, '^\\s+|\\s+$', '', 'g') <> ''""")
def label_names_saved(spark, sf):
    """The label names as they are saved for the list of diseases."""
    from ..sources import writers as W

    path = _folder(spark, "label_names_saved")
    W.save_label_names(label_clean(spark, sf), path)
    return spark.read.parquet(path)


@query("WITH " + instants_sql("SELECT item_id, received_at, meta.date AS t, NULL::VARCHAR AS tz FROM corpus_item") + " SELECT item_id, CASE WHEN year(make_timestamp(utc_us)) >= 1900 AND utc_us <= epoch_us(received_at) + 86400000000 THEN utc_us END AS utc_us FROM instants")
def sane_dates(spark, sf):
    """Dates of items, unless they lie before 1900 or more than a day after the item was received."""
    from ..operators import posts as P

    d = _items(spark, sf).where("meta.date is not null").select("item_id", TS.utc_micros(F.col("meta.date")).alias("u"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("seen"))
    return d.select("item_id", P.sane_date(F.col("u"), F.col("seen")).alias("utc_us"))


@query("""SELECT item_id, md5(to_json({'item_id': item_id, 'name': name, 'split': split, 'received_at': strftime(received_at, '%Y-%m-%dT%H:%M:%S')})::VARCHAR) AS json_md5 FROM corpus_item""")
def item_json(spark, sf):
    """Items as JSON objects, nulls kept and times in ISO form."""
    from ..functions import structs as ST

    return _items(spark, sf).select("item_id", F.md5(ST.json_row("item_id", "name", "split", "received_at")).alias("json_md5"))


@query("""SELECT item_id, array_to_string(list_transform(flatten([coalesce(labels, []), ['infection', 'death']]), lambda x: CASE x WHEN 'infection' THEN 'case' WHEN 'death' THEN 'deaths' ELSE x END), '|') AS attributes FROM (SELECT item_id, list_filter(flatten(list_transform(meta.events, lambda e: coalesce(e.diseases, []))), lambda x: x IS NOT NULL) AS labels FROM corpus_item)""")
def remapped_attributes(spark, sf):
    """Nested lists flattened, and attributes replaced by a map."""
    from ..functions import structs as ST

    own = F.filter(F.coalesce(H.diseases(), F.array().cast("array<string>")), lambda x: x.isNotNull())
    both = ST.flattened(F.array(own, F.array(F.lit("infection"), F.lit("death"))), 1)
    return _items(spark, sf).select("item_id", F.array_join(ST.remapped(both, {"infection": "case", "death": "deaths"}), "|").alias("attributes"))
