import math
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from epiquery.operators import corpus as C
from epiquery.operators import evaluate as V
from epiquery.operators import lexicon as L
from epiquery.operators import posts as P
from epiquery.operators import scoring as S
from epiquery.operators import spans as SP
from epiquery.operators import train as T


def test_cutoff_lift(spark):
    p = spark.createDataFrame([(1, "child", 0.6), (1, "other", 0.8), (1, "parent", 0.1)], "id bigint, class string, p double")
    a = spark.createDataFrame([("child", "parent"), ("child", "absent")], "class string, ancestor string")
    assert rows(S.best_guess(p, a, "id", 0.7)) == [(1, "child", 0.6), (1, "other", 0.8), (1, "parent", 0.6)]


def test_explanations(spark):
    f = spark.createDataFrame([(1, "a", 1.0), (1, "[linked] b", 1.0)], "id bigint, feature string, value double")
    w = spark.createDataFrame([("k", "a", 3.0), ("k", "[linked] b", 4.0)], "class string, feature string, coef double")
    g = spark.createDataFrame([(1, "k", 0.5)], "id bigint, class string, p double")
    base = spark.createDataFrame([(1, "a")], "id bigint, feature string")
    got = {r.feature: (round(r.score, 9), r.direct) for r in S.explanations(g, f, base, w, "id").collect()}
    assert got == {"[linked] b": (0.4, False), "a": (0.3, True)}
    b = spark.createDataFrame([("k", -7.0)], "class string, intercept double")
    docs = spark.createDataFrame([(1,), (2,)], "id bigint")
    got = {r.id: r.p for r in S.probabilities(f, w, b, "id", docs).collect()}
    assert got[1] == 0.5 and abs(got[2] - 1 / (1 + math.exp(7))) < 1e-12


def test_metrics(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "id bigint, label string")
    p = spark.createDataFrame([(1, "a"), (2, "c")], "id bigint, label string")
    m = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in V.by_label(t, p, "id").collect()}
    assert m == {"a": (1, 0, 1, 1.0, 0.5), "b": (0, 0, 1, 0.0, 0.0), "c": (0, 1, 0, 0.0, 0.0)}
    assert V.micro(V.by_label(t, p, "id")).first().precision == 0.5
    assert rows(V.misclassified(t, p, "id")) == [(1, "a|b", "a"), (2, "a", "c")]
    assert V.macro(V.by_label(t.where("false"), p.where("false"), "id")).first().f == 0.0


def test_acceptance(spark):
    items = spark.createDataFrame([("n1", ["Flu"]), ("n2", ["Flu", None]), ("n3", ["Nope"]), ("n4", []), ("n5", None), ("28453610000", ["Nope"])], "name string, d array<string>")
    labels = spark.createDataFrame([("Flu",), (None,)], "label string")
    got = {r.name: (r.labels, r.reason) for r in C.accepted(items, F.col("name"), F.col("d"), labels, "label").collect()}
    assert got == {"n1": (["Flu"], None), "n2": (["Flu"], "unknown label"), "n3": (["Nope"], "unknown label"), "n4": ([], "no label"), "n5": ([], "no label"), "28453610000": (["Dengue"], None)}


def test_earliest_split(spark):
    r = spark.createDataFrame([("big", i // 2, i) for i in range(12)] + [("small", i, i) for i in range(9)] + [("big", None, 99)], "label string, ts int, id bigint")
    got = C.earliest_split(r, "label", "ts", "id").where("split = 'test'")
    assert rows(got.select("label", "id")) == [("big", i) for i in range(5)]


def test_case_rule_and_blocklist(spark):
    k = spark.createDataFrame([("MERS",), ("Mers",), ("12",), ("A B",), ("NIPAHVI",)], "k string")
    assert [r[0] for r in k.select(L.is_case_sensitive(F.col("k"))).collect()] == [True, False, True, False, False]
    import pytest

    with pytest.raises(Exception, match="blocked"):
        L.checked(spark.createDataFrame([("the",)], "keyword string")).collect()


def test_subject_lines(spark):
    d = spark.createDataFrame([("PRO/AH/EDR> Anthrax - USA (05): (TX) update",), ("PROMED: old style",), ("free text",)], "s string")
    f = P.subject_fields(F.col("s"))
    got = [tuple(r) for r in d.select(*[f[c] for c in ("ns1", "ns2", "description", "region", "thread_num", "additional_info", "is_malformed")]).collect()]
    assert got == [("AH", "EDR", "Anthrax", "USA", 5, "(TX) update", False), (None, None, "old style", None, None, None, False), (None, None, "free text", None, None, None, True)]


POST = """Published Date: 2014-06-08 10:00:00
Subject: PRO> Anthrax - USA
Archive Number: 20140608.1
[Seen before. - Mod.JW]
******
[1] First
Date: 5 Jun 2014
Source: Daily News [edited]
http://daily.example/a
Body one.
--
Communicated by:
A Reader
******
more of it
******
A ProMED-mail post
"""


def test_articles(spark):
    d = spark.createDataFrame([(1, POST)], "id bigint, t string")
    assert [r[0] for r in d.select(P.moderator_comments(F.col("t"))).collect()][0][0].moderator == "JW"
    f = P.article_fields(F.col("section"))
    got = P.articles(d.withColumn("t", P.without_comments(F.col("t"))), "id", F.col("t")).select("article", *[v.alias(k) for k, v in f.items()]).collect()
    assert len(got) == 1 and got[0].source_name.strip() == "Daily News" and got[0].source_url == "http://daily.example/a" and got[0].heading == "First"
    assert got[0].date_text.strip() == "5 Jun 2014" and got[0].content.startswith("Body one.") and got[0].communicated_by.startswith("A Reader")


def test_spans(spark):
    s = spark.createDataFrame([(1, "k", 0, 5, "a"), (1, "k", 4, 9, "b"), (1, "k", 9, 12, "c"), (1, "k", 0, 9, "d"), (1, "k", 0, 9, "d")], "id bigint, type string, start int, end int, label string")
    assert [(r.start, r.end) for r in SP.optimal_spans(s, "id").orderBy("start").collect()] == [(0, 9), (9, 12)]
    o = spark.createDataFrame([(1, 5, 6), (2, 0, 9)], "id bigint, start int, end int")
    assert rows(SP.without_overlaps(s, o, "id").select("label").distinct()) == [("a",), ("c",)]
    d = spark.createDataFrame([(1, "On 3 May: 12 cases, 7 deaths"), (2, None), (3, "")], "id bigint, t string")
    assert [(r.type, r.value) for r in SP.count_features(SP.pattern_spans(d, "id", F.col("t"), SP.COUNT), "id").orderBy("start", "type").collect()] == [("caseCount", 12), ("count", 12), ("count", 7)]
    k = spark.createDataFrame([("x", "May", False), ("x", "ON", True)], "type string, keyword string, case_sensitive boolean")
    assert rows(SP.keyword_spans(d, "id", F.col("t"), k)) == [(1, "x", 5, 8, "may")]


def test_training_separates(spark, scratch):
    f = spark.createDataFrame([(i, "flu" if i % 2 else "pox", 1.0) for i in range(40)] + [(i, "noise", 1.0) for i in range(40)], "id bigint, feature string, value double")
    y = spark.createDataFrame([(i, "Flu" if i % 2 else "Pox") for i in range(40)], "id bigint, label string")
    w, b = T.one_vs_rest(f, y, "id", scratch)
    p = {(r.id, r["class"]): r.p for r in S.probabilities(f, w, b, "id").collect()}
    assert p[1, "Flu"] > 0.7 > 0.3 > p[0, "Flu"]
    v = [tuple(r) for r in T.vocabulary(f, scratch).orderBy("index").collect()]
    assert v == [("flu", 0), ("noise", 1), ("pox", 2)]


def test_training_reaches_the_optimum(spark, scratch):
    r = random.Random(1)
    x = {i: {c: r.choice([1.0, 0.5]) for c in "abcde" if r.random() < 0.4} | {"all": 1.0} for i in range(60)}
    y = {(i, k) for i in x for k in ("K", "L") if "b" not in x[i] and r.random() < (0.7 if "a" in x[i] else 0.2)}  # b stands in negatives only
    f = spark.createDataFrame([(i, c, v) for i in x for c, v in x[i].items()], "id bigint, feature string, value double")
    w, b = T.one_vs_rest(f, spark.createDataFrame(sorted(y) + [(99, "K"), (98, "none")], "id bigint, label string"), "id", scratch)
    w, b = {(q["class"], q.feature): q.coef for q in w.collect()}, {q["class"]: q.intercept for q in b.collect()}
    assert set(w) == {(k, c) for k in "KL" for c in ["a", "all", "b", "c", "d", "e"]} and set(b) == {"K", "L"} and w["K", "b"] < -0.5
    for k in "KL":
        err = {i: 1 / (1 + math.exp(-b[k] - sum(w[k, c] * v for c, v in x[i].items()))) - ((i, k) in y) for i in x}
        assert abs(b[k] + sum(err.values())) < 1e-4
        assert all(abs(w[k, c] + sum(err[i] * x[i].get(c, 0) for i in x)) < 1e-4 for c in ["a", "all", "b", "c", "d", "e"])
    assert T.one_vs_rest(f.where("false"), spark.createDataFrame([], "id bigint, label string"), "id", scratch)[0].count() == 0


def test_a_direct_newton_step_finds_what_conjugate_gradients_find(monkeypatch):
    r = np.random.default_rng(3)
    row, col = np.repeat(np.arange(40), 3), np.concatenate([r.choice(12, 3, replace=False) for _ in range(40)])
    value, n = r.uniform(0.2, 1, 120), r.integers(1, 300, 40).astype(float)
    for most in (0, 0.01, 1):
        pos = np.floor(n * r.uniform(0, most, 40))
        got = [w for direct in (1 << 24, 0) if not monkeypatch.setattr(T, "DIRECT", direct, raising=False) for w in [T._solve(row, col, value, n, pos, 12, 1e-9)]]
        assert np.abs(got[0] - got[1]).max() < 1e-6


def test_classes_with_the_same_positives_are_solved_once(monkeypatch):
    """Each of thousands of rare classes was once a problem of its own."""
    calls = []
    monkeypatch.setattr(T, "_solve", lambda *a: calls.append(a) or a[4] * 2)
    pos = {f"c{i}": np.array([i % 3, 1.0]) for i in range(30)}
    got = T._solve_each(None, None, None, None, pos, 2, 1e-6)
    assert len(calls) == 3 and [w.tolist() for w in got] == [[i % 3 * 2.0, 2.0] for i in range(30)]
