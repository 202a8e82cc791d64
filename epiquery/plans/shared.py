"""Inputs shared by the queries of the reference's operators, and the SQL fragments that state the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diagnose import LabelModel
from ..storage import Scratch, table

TOKENS = r"regexp_extract_all({}, 'http\S*[\p{{L}}\p{{N}}_]|[\p{{L}}\p{{N}}_]+')"


def sql_tokens(expr: str) -> str:
    return TOKENS.format(expr)


#: cleaned label rows, parent edges (missing parents added); anc: every label that is met by following parents, itself too on a
#: cycle; tree: the ancestors of labels whose way ends; below: as tree, and of labels below a cycle those up to the first label on it
LABELS = r"""
lt AS (SELECT regexp_replace(label, '^\s+|\s+$', '', 'g') AS label, nullif(regexp_replace(parent_label, '^\s+|\s+$', '', 'g'), '') AS parent, row_no FROM label_table WHERE label IS NOT NULL),
own AS (SELECT label, arg_max(parent, row_no) FILTER (WHERE parent IS NOT NULL) AS parent FROM lt WHERE label <> '' GROUP BY label),
edges AS (SELECT label, parent FROM own UNION ALL SELECT DISTINCT parent, NULL FROM own WHERE parent IS NOT NULL AND parent NOT IN (SELECT label FROM own)),
walk AS (SELECT label, parent AS ancestor, 1::BIGINT AS distance FROM edges WHERE parent IS NOT NULL
  UNION ALL SELECT w.label, e.parent, w.distance + 1 FROM walk w JOIN edges e ON e.label = w.ancestor WHERE e.parent IS NOT NULL AND w.distance < 600),
endless AS (SELECT DISTINCT label FROM walk WHERE distance = 600),
anc AS (SELECT label, ancestor, min(distance) AS distance FROM walk GROUP BY label, ancestor),
tree AS (SELECT * FROM walk WHERE label NOT IN (SELECT label FROM endless)),
ring AS (SELECT label, min(distance) AS d FROM walk WHERE label IN (SELECT label FROM endless) AND ancestor IN (SELECT label FROM walk WHERE label = ancestor) GROUP BY label),
below AS (SELECT w.* FROM walk w LEFT JOIN ring r ON r.label = w.label WHERE w.label NOT IN (SELECT label FROM walk WHERE label = ancestor) AND (r.d IS NULL OR w.distance <= r.d))"""

#: keywords of up to five tokens, and how often they stand in the documents
KEYWORDS = rf"""
kt AS (SELECT label, {sql_tokens("lower(label)")} AS t FROM edges),
kw AS (SELECT label, array_to_string(t, ' ') AS keyword, t[1] AS first, len(t) AS n FROM kt WHERE len(t) BETWEEN 1 AND 5),
dt AS (SELECT doc_id, {sql_tokens("lower(text)")} AS toks FROM documents WHERE text IS NOT NULL),
dp AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM dt),
base AS (SELECT doc_id, keyword, count(*)::BIGINT AS n FROM dp JOIN (SELECT DISTINCT keyword, first, n FROM kw) k ON toks[pos] = first AND array_to_string(toks[pos:pos + n - 1], ' ') = keyword GROUP BY ALL)"""

#: links from keywords to their ancestors', and clamped features
FEATURES = r"""
links AS (SELECT DISTINCT k.keyword, a.keyword AS linked FROM anc JOIN (SELECT label, array_to_string(t, ' ') AS keyword FROM kt) k ON k.label = anc.label JOIN (SELECT label, array_to_string(t, ' ') AS keyword FROM kt) a ON a.label = anc.ancestor),
lf AS (SELECT doc_id, feature, sum(value) AS value FROM (SELECT doc_id, keyword AS feature, n::DOUBLE AS value FROM base UNION ALL SELECT doc_id, '[linked] ' || linked, n::DOUBLE FROM base JOIN links USING (keyword)) GROUP BY ALL),
feat AS (SELECT doc_id, feature, least(1.0, value) AS value FROM lf)"""

#: coefficients by rule, probabilities, cut-off and lift
SCORES = r"""
kn AS (SELECT label AS class, array_to_string(t, ' ') AS keyword FROM kt),
coef AS (SELECT class, keyword AS feature, 2.0::DOUBLE AS coef FROM kn UNION ALL SELECT class, '[linked] ' || keyword, 1.0::DOUBLE FROM kn),
z AS (SELECT doc_id, class, sum(coef * value) AS z FROM feat JOIN coef USING (feature) GROUP BY ALL),
p AS (SELECT doc_id, class, 1 / (1 + exp(-(z - 1.0))) AS p FROM z),
chosen AS (SELECT doc_id, class, p FROM (SELECT *, max(p) OVER (PARTITION BY doc_id) AS top FROM p) WHERE p >= top * 0.65),
up AS (SELECT c.doc_id, a.ancestor AS class, c.p FROM chosen c JOIN anc a ON a.label = c.class),
guess AS (SELECT doc_id, class, max(p) AS p FROM (SELECT * FROM chosen UNION ALL SELECT up.* FROM up JOIN p USING (doc_id, class) UNION ALL SELECT p.doc_id, p.class, p.p FROM p JOIN (SELECT DISTINCT doc_id, class FROM up) USING (doc_id, class)) GROUP BY ALL)"""


def with_(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def label_edges(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    return model(spark, sf, scratch).edges


def ancestors(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    """(label, ancestor, distance): the labels each label implies."""
    return model(spark, sf, scratch).pairs


def model(spark: SparkSession, sf: str, scratch: Scratch) -> LabelModel:
    return LabelModel(table(spark, sf, "label_table"), scratch)


def inline(spark: SparkSession, values: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def diseases(column: str = "meta.events"):
    """All diseases of an item's events, nulls kept; null without events."""
    return F.flatten(F.transform(F.col(column), lambda e: F.coalesce(e["diseases"], F.array().cast("array<string>"))))
