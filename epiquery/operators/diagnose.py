"""The flagship: ranked labels with probabilities and explanations for every text, from keyword matches to explanations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import url as U
from ..sources import artifacts as A
from ..storage import Scratch
from . import features as FE
from . import hierarchy as H
from . import scoring as S
from . import timestamps as TS


class LabelModel:
    """Lexicon, links, ancestors and coefficients made from a label table: every label is a keyword, a class, and linked to its
    ancestors. Classes score their own keyword with `own` and their linked one with `inferred`, unless trained coefficients are given.

    Edges and ancestors are built once for the files of the label table and read from the shared folder by every later query."""

    def __init__(self, labels: DataFrame, scratch: Scratch, own: float = 2.0, inferred: float = 1.0, intercept: float = -1.0, trained: tuple[DataFrame, DataFrame] | None = None):
        self.labels, self.scratch, self.own, self.inferred, self.intercept, self.trained = labels, scratch, own, inferred, intercept, trained
        self.edges = A.kept(labels, "label-edges", lambda: H.with_missing_parents(scratch.save(H.parent_edges(labels, "label", "parent_label", "row_no"))))
        self.keywords = self.edges.select("label", FE.X.normalised_keyword(F.col("label")).alias("keyword"))

    @functools.cached_property
    def pairs(self) -> DataFrame:
        """(label, ancestor, distance): the labels each label implies, round cycles too; made only for queries that need them."""
        return A.kept(self.labels, "label-ancestors", lambda: H.inferred_pairs(self.edges, self.scratch))

    @property
    def ancestors(self) -> DataFrame:
        return self.pairs.select(F.col("label").alias("class"), "ancestor")

    @property
    def links(self) -> DataFrame:
        norm = FE.X.normalised_keyword
        return self.pairs.select(norm(F.col("label")).alias("keyword"), norm(F.col("ancestor")).alias("linked")).distinct()

    @property
    def coefficients(self) -> DataFrame:
        if self.trained:
            return self.trained[0]
        one = lambda feature, coef: self.keywords.select(F.col("label").alias("class"), feature.alias("feature"), F.lit(coef).alias("coef"))
        return one(F.col("keyword"), self.own).unionByName(one(F.concat(F.lit(FE.LINKED), "keyword"), self.inferred))

    @property
    def intercepts(self) -> DataFrame:
        return self.trained[1] if self.trained else self.keywords.select(F.col("label").alias("class"), F.lit(self.intercept).alias("intercept"))

    def base(self, docs: DataFrame, doc: str, text: Column) -> DataFrame:
        """Keyword counts, saved: small beside the texts, and read more than once by what follows."""
        return self.scratch.save(FE.keyword_counts(docs, doc, text, self.keywords, "label"))

    def features(self, base: DataFrame, doc: str) -> DataFrame:
        return self.scratch.save(FE.clamped(FE.linked(base, self.links, doc)))


def diagnose(docs: DataFrame, doc: str, text: Column, model: LabelModel, ratio: float = S.CUTOFF) -> DataFrame:
    """(doc, class, p): the labels of each text. Texts without any keyword have none.

    Trained coefficients give each text a probability of every class, so there texts with the same features are scored once."""
    return by_features(model.features(model.base(docs, doc, text), doc), doc, model, ratio)


def by_features(f: DataFrame, doc: str, model: LabelModel, ratio: float = S.CUTOFF) -> DataFrame:
    """diagnose, of the saved features of the texts."""
    if model.trained:
        return S.guesses(f, model.coefficients, model.intercepts, model.ancestors, doc, ratio, model.scratch)
    return S.best_guess(model.scratch.save(S.probabilities(f, model.coefficients, model.intercepts, doc)), model.ancestors, doc, ratio)


def ranked(guessed: DataFrame, doc: str) -> DataFrame:
    """Adds `rank` within each text, by probability, then label."""
    return guessed.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("p"), "class")).cast("bigint"))


def as_json(guessed: DataFrame, explained: DataFrame, doc: str) -> DataFrame:
    """(doc, result): one JSON document a text, as a service would answer."""
    k = explained.groupBy(doc, "class").agg(F.sort_array(F.collect_list(F.when(F.col("direct"), F.struct(F.col("feature").alias("name"), "score")))).alias("keywords"), F.sort_array(F.collect_list(F.when(~F.col("direct"), F.struct(F.col("feature").alias("name"), "score")))).alias("inferred_keywords"))
    d = guessed.join(k, [doc, "class"], "left").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col("p").alias("probability"), F.col("class").alias("name"), "keywords", "inferred_keywords")), asc=False).alias("diseases"))
    return d.select(doc, F.to_json(F.struct(F.lit(__version__).alias("diagnoserVersion"), "diseases")).alias("result"))


def dispatched(requests: DataFrame, content: Column, url: Column, content_date: Column) -> DataFrame:
    """requests with `action` and `error`: text is diagnosed as it is, else the page of a valid link is fetched; what can't be done has an error.

    An unreadable date is refused first, then content counts before the link; a link needs a host that ends in a word."""
    bad_date = (content_date != "") & TS.utc_micros(content_date).isNull()
    error = F.when(bad_date, "Could not parse content date").when(content != "", None).when(url != "", F.when(~U.valid_host(url), "Invalid URL")).otherwise("Please provide a url or content to diagnose.")
    action = F.when(error.isNull(), F.when(content != "", "text").otherwise("fetch"))
    return requests.withColumn("action", action).withColumn("error", error)


def answered(results: DataFrame, result: str, error: str, source: Column | None = None) -> Column:
    """The JSON answer of a row: the error alone, or the result, with its source text if that is asked for (null: not)."""
    failed = F.to_json(F.struct(F.col(error).alias("error")))
    body = F.col(result) if source is None else F.when(source.isNotNull(), F.concat(F.expr(f"left({result}, length({result}) - 1)"), F.lit(', "source": '), F.to_json(F.struct(F.struct(source.alias("content")).alias("cleanContent"))), F.lit("}"))).otherwise(F.col(result))
    return F.when(F.col(error).isNotNull(), failed).otherwise(body)


def search_and_diagnose(results: DataFrame, position: str, title: Column, content: Column, model: LabelModel, most: int = 200) -> DataFrame:
    """(position, class, p) of the first `most` search results, read as title and content; one without any label has a row without a class."""
    top = results.orderBy(position).limit(most).select(position, F.concat_ws("\n", title, content).alias("t"))
    return top.select(position).distinct().join(diagnose(top, position, F.col("t"), model), position, "left")


def versions() -> dict[str, str]:
    return {"engine": __version__, "diagnoser": __version__}
