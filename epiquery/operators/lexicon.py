"""Keyword lexicon: validation, case rule, category filters and type map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

# Keywords that must not enter a lexicon, categories used in training, and the annotation type of categories.
BLOCKED = ["can", "don", "dish", "ad", "mass", "yellow", "the", "Consumption"]
TRAINING_CATEGORIES = [
    "hm/disease", "biocaster/pathogens", "biocaster/diseases", "biocaster/symptoms", "symp/symptoms", "eha/symptom", "eha/mode of transmission",
    "eha/environmental factors", "eha/vector", "eha/occupation", "eha/control measures", "eha/description of infected", "eha/disease category",
    "eha/host", "eha/host use", "eha/disease", "eha/location", "eha/transmission", "eha/zoonotic type", "eha/risk", "wordnet/season",
    "wordnet/climate", "wordnet/pathogens", "wordnet/hosts", "wordnet/mod/severe", "wordnet/mod/painful", "wordnet/mod/large",
    "wordnet/mod/rare", "doid/has_symptom", "doid/symptoms", "doid/transmitted_by", "doid/located_in", "doid/diseases", "doid/results_in",
    "doid/has_material_basis_in", "usgs/terrain",
]
TYPES = {
    "doid/diseases": "diseases", "eha/disease": "diseases", "pm/disease": "diseases", "hm/disease": "diseases", "biocaster/diseases": "diseases",
    "eha/symptom": "symptoms", "biocaster/symptoms": "symptoms", "doid/has_symptom": "symptoms", "pm/symptom": "symptoms", "symp/symptoms": "symptoms",
    "wordnet/hosts": "hosts", "eha/vector": "hosts", "wordnet/pathogens": "pathogens", "biocaster/pathogens": "pathogens",
    "pm/mode of transmission": "modes", "doid/transmitted_by": "modes", "eha/mode of transmission": "modes",
}


def is_case_sensitive(keyword: Column) -> Column:
    """Short, without blanks, and the same in upper case (digits alone qualify)."""
    return ~keyword.contains(" ") & (F.length(keyword) <= 6) & (F.upper(keyword) == keyword)


def problem(keyword: Column) -> Column:
    """What is wrong with a keyword; null if nothing. Empty keywords are to be skipped, the others to be refused."""
    return F.when(keyword.isin(BLOCKED), "blocked").when(keyword.isNull() | (keyword == ""), "empty").when(keyword != trim(keyword), "untrimmed")


def checked(keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """Skips empty keywords; a blocked or untrimmed one raises."""
    k, p = F.col(keyword), problem(F.col(keyword))
    ok = F.when(p.isin("blocked", "untrimmed"), F.raise_error(F.concat(p, F.lit(" keyword: "), k)).cast("string")).otherwise(k)
    return keywords.where(~p.eqNullSafe("empty")).withColumn(keyword, ok)


def build(synsets: DataFrame, synonyms: str = "synonyms", parents: str = "parent_synonyms", category: str = "category") -> DataFrame:
    """(keyword, category, linked_keywords, case_sensitive, duplicate): one row for each synonym of each synset.

    duplicate is true from the second time a keyword is seen, in the order of category and synset."""
    links = F.transform(F.array_sort(F.array_distinct(F.filter(F.col(parents), lambda x: x.isNotNull()))), lambda x: F.concat(F.lit("[linked] "), x))
    k = synsets.select(F.explode(F.array_distinct(synonyms)).alias("keyword"), F.col(category).alias("category"), links.alias("linked_keywords")).where("keyword <> ''")
    order = Window.partitionBy("keyword").orderBy("category", F.array_join("linked_keywords", "|"))
    return k.select("keyword", "category", "linked_keywords", is_case_sensitive(F.col("keyword")).alias("case_sensitive"), (F.row_number().over(order) > 1).alias("duplicate"))


def excluding(synsets: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    """synsets without the given terms in any of the array columns (synonyms and parent_synonyms by default)."""
    gone = F.array(*map(F.lit, terms)).cast("array<string>")
    return synsets.withColumns({c: F.array_except(c, gone) for c in columns or ("synonyms", "parent_synonyms")})


def for_training(keywords: DataFrame) -> DataFrame:
    return keywords.where(F.col("category").isin(TRAINING_CATEGORIES))


def unused_categories(keywords: DataFrame) -> DataFrame:
    return keywords.where(~F.col("category").isin(TRAINING_CATEGORIES)).select("category").distinct()


def keyword_type(category: Column) -> Column:
    """Annotation type of a category; null if it has none."""
    return F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[category]


def last_by_type(keywords: DataFrame, order: str) -> DataFrame:
    """(type, lowered, keyword): of keywords equal in lower case within a type the last one stays."""
    k = keywords.select(keyword_type(F.col("category")).alias("type"), F.lower("keyword").alias("lowered"), "keyword", order).where("type is not null")
    return k.groupBy("type", "lowered").agg(F.max_by("keyword", order).alias("keyword"))
