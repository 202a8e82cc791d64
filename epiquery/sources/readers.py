"""Sources. All give DataFrames with fixed schemas; nothing is inferred from the data."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

LABEL_COLUMNS = "label string, is_not_disease string, is_pathogen string, is_promed_label string, parent_label string, not_human_disease string, is_category string, wiki_link string, synonym string, non_hm_label string, comments string"
LABEL_FLAGS = ("is_not_disease", "is_pathogen", "is_promed_label", "not_human_disease", "is_category", "non_hm_label")


def cleaned_labels(rows: DataFrame) -> DataFrame:
    """Strips cells, reads TRUE and FALSE (others are null), empties to null, and drops rows without a label."""
    out = rows
    for c, t in rows.dtypes:
        if t == "string":
            v = X.trim(F.col(c))
            v = F.when(v != "", v)
            out = out.withColumn(c, F.when(v == "TRUE", True).when(v == "FALSE", False) if c in LABEL_FLAGS else v)
    return out.where("label is not null")


def not_human(labels: DataFrame, order: str = "row_no") -> DataFrame:
    """(label, not_human) of cleaned labels: by its first row, whether a label is no disease or none of humans. Unknown labels have no row."""
    first = F.min_by(F.coalesce("is_not_disease", F.lit(False)) | F.coalesce("not_human_disease", F.lit(False)), order)
    return labels.groupBy("label").agg(first.alias("not_human"))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    return cleaned_labels(spark.read.csv(path, schema=LABEL_COLUMNS, header=True, quote='"', escape='"', multiLine=True))


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """One label a line, as "- label" (a YAML list)."""
    got = F.regexp_extract("value", r"^\s*-\s*[\"']?(.*?)[\"']?\s*$", 1)
    return spark.read.text(path).select(got.alias("label")).where("label <> ''")


def corpus_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored items as JSON lines, with the nested schema of the corpus."""
    schema = """name string, meta struct<date string, events array<struct<diseases array<string>>>>, private struct<cleancontent struct<content string, malformed boolean,
    clearnerversion string>, englishtranslation struct<content string, error string>, scrapeddata struct<scraperversion string, unscrapable boolean, url string, sourceurl string>>"""
    return spark.read.schema(schema).json(path)


def curated_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of curated items."""
    return spark.read.schema("id string, created string, labels array<string>, content string").json(path, multiLine=True)


def rdf_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """(subject, predicate, object) of N-Triples files; missing files and other lines are skipped. Local names only."""
    rx = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    lines = spark.read.option("ignoreMissingFiles", "true").text(list(paths))
    g = lambda n: F.regexp_extract("value", rx, n)
    short = lambda c: F.regexp_replace(c, r"^.*[/#]", "")
    return lines.where(F.col("value").rlike(rx)).select(short(g(1)).alias("subject"), short(g(2)).alias("predicate"), F.when(g(3) != "", short(g(3))).otherwise(g(4)).alias("object"))


_TERM = re.compile(r'''\s+|\#[^\n]*|(?P<iri><[^>]*>)|"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<text>(?:[^"\\\n]|\\.)*)"|(?P<at>@[A-Za-z-]+)|(?P<type>\^\^)|(?P<mark>[;,.\[\]()])|(?P<name>[^\s;,<>"\[\]()]*[^\s;,.<>"\[\]()])''')


def _turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of a Turtle document by local names: prefixes, predicate and object lists, literals with language or type. Blank nodes are skipped."""
    out, subject, predicate, depth, directive, typed = [], None, None, 0, False, False
    short = lambda x: re.sub(r"^.*[/#:]", "", x.strip("<>"))
    for m in _TERM.finditer(text):
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "mark":
            depth += {"[": 1, "(": 1, "]": -1, ")": -1}.get(m[0], 0)
            if not depth and m[0] in ".;":
                predicate = None
                if m[0] == ".":
                    subject, directive = None, False
            continue
        if kind == "at" and m[0] in ("@prefix", "@base") or kind == "name" and m[0].upper() in ("PREFIX", "BASE") and subject is None:
            directive = m[0][0] == "@" or None
            continue
        if directive is None:  # without @, a directive ends with its link
            directive = None if kind == "name" else False
            continue
        if depth or directive or kind == "at":
            continue
        if kind == "type" or typed:
            typed = kind == "type"
            continue
        value = m["long"] if kind == "long" else m["text"] if kind == "text" else short(m[0])
        if kind in ("long", "text"):
            value = re.sub(r'\\(["\\])', r"\1", value)
        if subject is None:
            subject = value
        elif predicate is None:
            predicate = "type" if m[0] == "a" else value
        else:
            out.append((subject, predicate, value))
    return out


def turtle_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """(subject, predicate, object) of Turtle files, local names only, each file read by one task; missing files are skipped."""

    def rows(batches):
        for batch in batches:
            got = [t for text in batch.column(0).to_pylist() for t in _turtle(text)]
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in got], pa.string()) for i in range(3)], names=["subject", "predicate", "object"])

    found = [x for x in paths if _exists(spark, x)]
    files = spark.read.option("ignoreMissingFiles", "true").text(found, wholetext=True) if found else spark.createDataFrame([], "value string")
    return files.mapInArrow(rows, "subject string, predicate string, object string")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


#: elements of an RDF/XML class that hold text, by the name of their predicate
TEXTS = {"label": "rdfs:label", "hasExactSynonym": "oboInOwl:hasExactSynonym", "hasRelatedSynonym": "oboInOwl:hasRelatedSynonym", "hasNarrowSynonym": "oboInOwl:hasNarrowSynonym", "definition": "obo:IAO_0000115"}


def rdf_xml(spark: SparkSession, path: str, row_tag: str = "owl:Class") -> DataFrame:
    """Triples of the classes of an RDF/XML ontology: labels, synonyms, definition and subClassOf."""
    schema = "`_rdf:about` string, " + ", ".join(f"`{e}` array<struct<_VALUE string>>" for e in TEXTS.values()) + ", `rdfs:subClassOf` array<struct<`_rdf:resource` string>>"
    x = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    short = lambda c: F.regexp_replace(c, r"^.*[/#]", "")
    named = lambda p: lambda o: F.struct(F.lit(p).alias("predicate"), o["_VALUE"].alias("object"))
    texts = [F.transform(F.coalesce(F.col(f"`{e}`"), F.array()), named(p)) for p, e in TEXTS.items()]
    parents = F.transform(F.coalesce(F.col("`rdfs:subClassOf`"), F.array()), lambda o: F.struct(F.lit("subClassOf").alias("predicate"), short(o["_rdf:resource"]).alias("object")))
    t = x.select(short(F.col("`_rdf:about`")).alias("subject"), F.explode(F.concat(*texts, parents)).alias("t"))
    return t.select("subject", "t.predicate", "t.object").where("object is not null")


def synsets(spark: SparkSession, path: str) -> DataFrame:
    """Word senses as JSON lines: (synset, pos, lemmas, hyponyms, derived); synset names are "<lemma>.<pos>.<number>"."""
    return spark.read.schema("synset string, pos string, lemmas array<string>, hyponyms array<string>, derived array<string>").json(path)


def senses(words: DataFrame, word: str, first: int = 0, past: int | None = None, nouns_only: bool = False) -> DataFrame:
    """The synsets of a word in the order of their numbers, cut to [first, past)."""
    n = F.regexp_extract("synset", r"\.(\d+)$", 1).cast("int")
    own = words.where(F.array_contains("lemmas", word) & ((F.col("pos") == "n") if nouns_only else F.lit(True)))
    r = own.withColumn("place", F.row_number().over(Window.orderBy(n, "synset")) - 1)  # the senses of one word
    return r.where((F.col("place") >= first) & (F.col("place") < past if past is not None else F.lit(True))).drop("place")


def sheet_key(url: str) -> str | None:
    """Key of a spreadsheet link: ?key=..., or the path part after /d/."""
    m = re.search(r"[?&]key=([^&#]+)", url) or re.search(r"/d/([^/?#]+)", url)
    return m[1] if m else None


def sheet_rows(raw: DataFrame, column: str = "value") -> DataFrame:
    """(type, keyword, synonyms) of JSONP sheet answers; rows without a type are skipped, synonyms split at commas."""
    body = F.regexp_extract(F.col(column), r"(?s)^[^({\[]*\((.*)\)\s*;?\s*$", 1)
    schema = "feed struct<entry array<struct<type string, keyword string, synonyms string>>>"
    e = raw.select(F.from_json(F.when(body != "", body).otherwise(F.col(column)), schema).alias("j")).select(F.explode("j.feed.entry").alias("e")).select("e.*")
    return e.where("type <> ''").select("type", F.trim("keyword").alias("keyword"), X.split_trimmed(F.coalesce("synonyms", F.lit("")), ",").alias("synonyms"))


def newest_version(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """(name, version): the artifact "<prefix><digits>.<ending>" with the highest number."""
    v = F.regexp_extract(column, rf"^{re.escape(prefix)}(\d+)(\.|$)", 1)
    d = names.select(F.col(column).alias("name"), F.when(v != "", v).cast("bigint").alias("version")).where("version is not null")
    return d.agg(F.max_by("name", "version").alias("name"), F.max("version").alias("version"))


def entity_lookup(entities: DataFrame, synonyms: DataFrame, query: str, kind: str = "disease") -> DataFrame:
    """Entities of a kind with a synonym equal to the query, case aside."""
    hit = synonyms.where(F.lower("synonym") == query.lower()).select("entity_id").distinct()
    return entities.where(F.col("kind") == kind).join(hit, "entity_id", "left_semi")


def entity(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.where(F.col("entity_id") == entity_id)
