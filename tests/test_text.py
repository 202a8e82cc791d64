import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epiquery.functions import text as X
from epiquery.functions import url as U
from epiquery.operators import features as FE


def one(spark, col, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(col(F.col("t"))).collect()]


def test_urls_are_one_token(spark):
    assert one(spark, X.tokens, "See http://un-dx.example.com/KZ-MAP.gif now", None, "", "Hepatitis A, É_1") == [["see", "http://un-dx.example.com/kz-map.gif", "now"], None, [], ["hepatitis", "a", "é_1"]]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(X.ngrams(F.col("t"), 2)).collect()] == [["a", "b", "c", "a b", "b c"], []]


def reference_scan(text):
    found = re.findall(r"(?ai)\b(?:%s)\b" % "|".join(X.ENGLISH_WORDS), text)
    n, seen = len(text) // 100, set()
    for total, w in enumerate(found, 1):
        if w in seen:
            continue
        seen.add(w)
        if len(seen) > min(5, n) and total > n:
            return True
    return False


def test_english(spark):
    viet = "Trong 10 ngày qua, khoa cấp cứu đã báo cáo mức tăng 5 phần trăm số lượt khám dọc đường từ Katipe đến Mopamo."
    texts = ["The cat sat on the mat and it was good for all of us", viet, "", "the " * 300, "it", "one two " * 40 + "x" * 900, "éit to be"]
    assert one(spark, X.is_english, *texts) == [reference_scan(t) for t in texts]


def test_chunks_and_selection(spark):
    assert one(spark, lambda c: X.chunks(c, 5), "ab cd ef", "") == [["ab cd ", "ef"], []]
    df = spark.createDataFrame([("t", "c"), ("", "c"), (None, "c"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.selected_text(F.col("a"), F.col("b"))).collect()] == ["t", "c", "c", None]


def test_routes(spark):
    urls = ["http://promedmail.org/direct.php?id=20140919.436908", "http://x.org/a/plan_eng.pdf?ua=1", "http://news.google.com/n?x=1&url=http://focus.example.com/a", "https://twitter.com/x", "nohost", None, "http://ok.example/a"]
    assert one(spark, U.route, *urls) == ["post", "unscrapable", "unwrap", "unscrapable", "unscrapable", "none", "fetch"]
    assert one(spark, U.unwrapped, urls[2], urls[6]) == ["http://focus.example.com/a", "http://ok.example/a"]
    assert one(spark, U.post_id, urls[0], urls[6]) == ["20140919.436908", None]


def test_keyword_counts(spark):
    docs = spark.createDataFrame([(1, "Dengue and dengue fever; meningococcal septicaemia and respiratory illness"), (2, None), (3, ""), (1, "x")], "id bigint, t string")
    kw = spark.createDataFrame([("Dengue",), ("dengue fever",), ("respiratory illness",), ("a b c d e f",), (None,), ("",), ("Dengue",)], "k string")
    assert set(rows(FE.keyword_counts(docs, "id", F.col("t"), kw, "k"))) == {(1, "dengue", 2), (1, "dengue fever", 1), (1, "respiratory illness", 1)}


def test_links_clamp_rename(spark):
    f = spark.createDataFrame([(1, "h5n1", 3)], "id bigint, keyword string, n bigint")
    links = spark.createDataFrame([("h5n1", "flu"), ("h5n1", "flu"), ("h5n1", "virus")], "keyword string, linked string")
    assert rows(FE.linked(f, links, "id", 0.5)) == [(1, "[linked] flu", 1.5), (1, "[linked] virus", 1.5), (1, "h5n1", 3.0)]
    assert rows(FE.clamped(FE.linked(f, links, "id"))) == [(1, "[linked] flu", 1.0), (1, "[linked] virus", 1.0), (1, "h5n1", 1.0)]


def test_html(spark):
    assert one(spark, X.html_to_text, "<p>a<br/>b  c</p><script>x</script><b>d</b>") == ["\n\na\nb c\n\nd"]


def test_structs(spark):
    import pytest

    from epiquery.functions import structs as ST

    df = spark.sql("select 1 as a, named_struct('b', 2, 'c', named_struct('d', 'x')) as s")
    assert ST.squashed(df).columns == ["a", "s/b", "s/c/d"]
    with pytest.raises(ValueError):
        ST.squashed(spark.sql("select named_struct('b', 2) as s, 3 as `s/b`"))
    got = spark.sql("select array('infection', 'x') as v, array(array(1), array(2)) as n, timestamp_ntz '2014-01-02 03:04:05' as t, cast(null as string) as z")
    r = got.select(ST.remapped(F.col("v"), {"infection": "case"}), ST.flattened(F.col("n"), 1), ST.json_row("t", "z")).first()
    assert tuple(r) == (["case", "x"], [1, 2], '{"t":"2014-01-02T03:04:05","z":null}')


def test_pages(spark):
    from epiquery.functions import pages as PG

    html = "<nav><a href=/>Home</a> <a href=/x>News</a></nav><p>" + "Long enough sentence about an outbreak. " * 3 + "</p><div>Share this</div>"
    assert one(spark, PG.main_text, html, "<p>short</p>", None) == [("Long enough sentence about an outbreak. " * 3).strip(), "short", None]
    df = spark.createDataFrame([(bytearray("é".encode("latin-1")), "latin-1"), (bytearray(b"\xff"), "nope"), (None, None), (bytearray("é".encode()), None), (bytearray(b"\xe9t\xe9"), None), (bytearray(b"\x81\x9f"), None)], "b binary, e string")
    assert [r[0] for r in df.select(PG.decoded("b", "e")).collect()] == ["é", "�", None, "é", "été", "Ѓџ"]


def test_locations(spark):
    from epiquery.operators import spans as SP

    s = spark.createDataFrame([(1, 0, 4, "Rome"), (1, 9, 13, "ROME"), (1, 5, 8, "xyz")], "id bigint, start int, end int, label string")
    g = spark.createDataFrame([(7, "Rome")], "geonameid bigint, name string")
    assert rows(SP.location_features(s, g, "id")) == [(1, 7, "Rome", "0-4 9-13")]


def test_lemmas_and_exclusions(spark):
    from epiquery.operators import lexicon as L

    assert one(spark, X.lemma_name, "red_fox.n.01", None) == ["red fox", None]
    assert one(spark, X.without_qualifier, "Flu (disorder)", "Pox ()", "Flu (x)") == ["Flu", "Pox", "Flu (x)"]
    s = spark.createDataFrame([(["a", "b"], ["c", None], "hm/disease")], "synonyms array<string>, parent_synonyms array<string>, category string")
    k = L.build(L.excluding(s, ["b"])).collect()
    assert [(r.keyword, r.linked_keywords, r.duplicate) for r in k] == [("a", ["[linked] c"], False)]


@pytest.mark.parametrize("piece", ["x", "<script>", "<a ", "<br ", "<!-- ", "<b> </b> ", "<p "])
def test_markup_takes_linear_time(spark, piece):
    import time

    from epiquery.functions import pages as PG

    def took(n):
        df = spark.createDataFrame([(piece * (n // len(piece)),)], "t string")
        began = time.perf_counter()
        df.select(F.length(X.html_to_text(F.col("t"))), F.length(PG.main_text(F.col("t"))), F.length(X.trim(F.col("t")))).collect()
        return time.perf_counter() - began

    took(1000)
    assert took(4_000_000) < 10 * max(took(1_000_000), 0.3)


def test_page_text_leaves_out_scripts_titles_and_comments(spark):
    from epiquery.functions import pages as PG

    body = "This is the first sentence of the article, and it is long enough. " * 2
    page = f"<html><head><title>T it le</title><style>p {{x}}</style></head><body><!-- <p>no</p> --><script>if (a<b) 'x'</script><p>{body}</p><ul><li><a href='#'>More</a></li></ul><noscript>off</noscript></body></html>"
    got = spark.createDataFrame([(page,), (None,), ("",), ("plain",)], "t string").coalesce(1).select(PG.main_text(F.col("t")), F.array_join(F.transform(PG.paragraphs(F.col("t")), lambda p: p["text"]), "|")).collect()
    assert got[0][0] == body.strip() and got[0][1] == f"{body.strip()}|More" and got[1][0] is None and got[2][0] == "" and got[3][0] == "plain"


def test_training_text_refuses_bad_translations(spark):
    f = lambda *row: spark.createDataFrame([row], "t string, e string, d boolean, c string").select(X.training_text(F.col("t"), F.col("e"), F.col("d"), F.col("c"))).first()[0]
    assert f("tr", None, True, "own") == "tr" and f(None, None, False, "own") == "own"
    for row in (("tr", "failed", True, "own"), ("", None, True, "own"), (None, None, True, "own")):
        with pytest.raises(Exception, match="bad translation"):
            f(*row)
