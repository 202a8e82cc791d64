"""Artifacts, requests, posts' dates, label rules, duplicates, incidents, and the two ways of matching a lexicon."""

import itertools
import random
import time

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as E
from epiquery.operators import corpus as C
from epiquery.operators import diagnose as D
from epiquery.operators import features as FE
from epiquery.operators import ontology as O
from epiquery.operators import posts as P
from epiquery.operators import scoring as S
from epiquery.operators import service as SV
from epiquery.operators import spans as SP
from epiquery.operators import train as T
from epiquery.plans import corpus_queries as CQ
from epiquery.plans import shared as H
from epiquery.sources import artifacts as A

US = 1_000_000


def test_versions_are_saved_loaded_and_listed(spark, tmp_path):
    folder = f"{tmp_path}/models"
    with pytest.raises(FileNotFoundError, match="coef-"):
        A.load(spark, folder, "coef-")
    assert A.versions(spark, folder, "coef-") == [] and A.next_name(spark, folder, "coef-") == "coef-1.parquet"
    for n in range(1, 12):
        A.save(spark.range(n), folder, "coef-")
    A.save(spark.range(50), folder, "coefficients-")
    assert [v[0] for v in A.versions(spark, folder, "coef-")] == list(range(1, 12)) and A.next_name(spark, folder, "coef-") == "coef-12.parquet"
    assert A.load(spark, folder, "coef-").count() == 11 and A.load(spark, folder, "coef-", 3).count() == 3


def test_fetch_if_newer(spark, tmp_path):
    remote, local = f"{tmp_path}/far/a.txt", f"{tmp_path}/near/a.txt"
    (tmp_path / "far").mkdir()
    (tmp_path / "far/a.txt").write_text("one")
    assert A.fetch_if_newer(spark, remote, local) and (tmp_path / "near/a.txt").read_text() == "one"
    assert not A.fetch_if_newer(spark, remote, local)
    time.sleep(1.1)
    (tmp_path / "far/a.txt").write_text("two")
    assert A.fetch_if_newer(spark, remote, local) and (tmp_path / "near/a.txt").read_text() == "two"
    with pytest.warns(UserWarning, match="stays in use"):
        assert not A.fetch_if_newer(spark, f"{tmp_path}/far/none", local)
    assert (tmp_path / "near/a.txt").read_text() == "two"


def test_kept_is_built_once_for_the_same_files(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    spark.range(3).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert [A.kept(t, "x", build).count() for _ in range(2)] == [1, 1] and len(built) == 1
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert A.kept(spark.read.parquet(f"{tmp_path}/t"), "x", build).count() == 2
    assert A.kept(spark.range(2), "x", build).count() == 3  # not from files: never kept


def test_requests(spark):
    data = [(1, "text", None, None), (2, "text", "http://a.org", "nonsense"), (3, "", "http://a.org/x", "2014-03-05"), (4, None, "http://127.0.0.1/x", None), (5, None, "", ""), (6, None, None, None)]
    df = spark.createDataFrame(data, "id int, content string, url string, date string")
    got = {r.id: (r.action, r.error) for r in D.dispatched(df, F.col("content"), F.col("url"), F.col("date")).collect()}
    none = "Please provide a url or content to diagnose."
    assert got == {1: ("text", None), 2: (None, "Could not parse content date"), 3: ("fetch", None), 4: (None, "Invalid URL"), 5: (None, none), 6: (None, none)}
    r = spark.createDataFrame([(1, '{"a":1}', None, 's"x'), (2, None, "bad", None), (3, '{"a":1}', None, None)], "id int, result string, error string, src string")
    assert {x.id: x.j for x in r.select("id", D.answered(r, "result", "error", F.col("src")).alias("j")).collect()} == {1: '{"a":1, "source": {"cleanContent":{"content":"s\\"x"}}}', 2: '{"error":"bad"}', 3: '{"a":1}'}


@pytest.mark.parametrize("t, want", [
    ("2-8 Jun 2014", 1402185600), ("Tues 3 Sept 2013", 1378166400), ("Thurs, 5 Jun 2014 10:00 -0400", 1401976800), ("3 Jun 2014 10:00 CST-6CDT", 1401811200),
    ("3 Jun 2014 10:00 -0500 EST", 1401807600), ("3 Jun 2014 10:00 -050", None), ("3 Jun 2014 10:00 -05000", None), ("3 Jun 2014 10 :00", None), ("3 Jun", None), (None, None),
])
def test_dates_of_posts(spark, t, want):
    got = spark.createDataFrame([(t,)], "t string").select(P.parsed_date(F.col("t"))).first()[0]
    assert got == (None if want is None else want * US)


def test_offsets_of_a_day_and_more(spark):
    df = spark.createDataFrame([(0, 3600), (0, 90000), (0, -90000)], "l bigint, o bigint")
    assert [r[0] // US for r in df.select(P.utc_of(F.col("l"), F.col("o"))).collect()] == [-3600, 86400 - 3600, -86400 + 3600]


def test_label_suffixes(spark):
    df = spark.createDataFrame([("Flu (Avian)",), ("Flu (avian) x",), ("Fever (Clinical)",), ("Pox (animal)",), ("(Human)",), (None,)], "l string")
    base, note, host = O.label_suffix(F.col("l"))
    assert [tuple(r) for r in df.select(base, note, host).collect()] == [("Flu", None, "Avian"), ("Flu", None, "avian"), ("Fever", "Clinical", None), ("Pox (animal)", None, None), ("(Human)", None, None), (None, None, None)]


def test_subject_labels_are_whole_words_in_table_order(spark):
    posts = spark.createDataFrame([(1, "Rift Valley fever & plague, suspected"), (2, "Plagues, fevers"), (3, None), (4, "H5N1 in A.B")], "id bigint, d string")
    labels = spark.createDataFrame([(7, "Plague"), (3, "rift valley, fever"), (9, "Fever and plague"), (4, "A.B"), (5, "AxB"), (6, "")], "row_no bigint, label string")
    assert rows(P.subject_labels(posts, "id", F.col("d"), labels, "label", "row_no")) == [(1, "Fever and plague", 9), (1, "Plague", 7), (1, "rift valley, fever", 3), (4, "A.B", 4)]


def test_posts_of_names_inside_words_by_publication(spark):
    posts = spark.createDataFrame([(1, 5, "Plague in X"), (2, 4, "the PLAGUES"), (3, None, "ague"), (4, 1, None)], "id bigint, at bigint, d string")
    names = spark.createDataFrame([("Ague",), ("Plague",), ("",), (None,)], "n string")
    assert rows(P.posts_of(posts, "id", F.col("d"), names, "n", "at")) == [("Ague", 1, 2), ("Ague", 2, 1), ("Ague", 3, 3), ("Plague", 1, 2), ("Plague", 2, 1)]
    assert P.posts_of(posts, "id", F.col("d"), names.where("n = ''"), "n", "at").count() == 0


def test_merged_duplicates_keep_the_first_item(spark):
    ev = lambda *ds: [(list(d) if d is not None else None,) for d in ds]
    data = [(2, "a", "x", ("d2", ev(["B", None], ["C"]))), (1, "a", "y", ("d1", ev(["A"], ["Z"]))), (3, "a", "z", ("d3", None)), (4, None, "n", ("d4", ev(None))), (5, None, "m", ("d5", ev(["Q"]))), (6, "e", "k", (None, []))]
    df = spark.createDataFrame(data, "i bigint, name string, __x string, meta struct<date: string, events: array<struct<diseases: array<string>>>>")
    got = {r.i: (r.name, r["__x"], r.meta and r.meta.date, r.meta.events and [e.diseases for e in r.meta.events]) for r in C.merged_duplicates(df, "name", "i", "meta").collect()}
    assert got == {1: ("a", "y", "d1", [["A", "B", None], ["Z"]]), 4: (None, "n", "d4", [["Q"]]), 6: ("e", "k", None, [])}


def test_renames_are_followed_to_their_end(spark, scratch):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s")], "keyword string, target string")
    assert rows(FE.resolved_renames(m, scratch)) == [("a", "c"), ("b", "c"), ("s", "s"), ("x", "y"), ("y", "y"), ("z", "y")]


def test_incidents_take_the_nearest(spark):
    c = spark.createDataFrame([(1, "count", 50, 60, "12 cases", 12, False), (1, "caseCount", 50, 60, "12 cases", 12, False), (1, "count", 90, 99, "3 patients", 3, False), (2, "count", 0, 8, "7 deaths", 7, False)], "id bigint, type string, start int, end int, label string, value bigint, cumulative boolean")
    d = spark.createDataFrame([(1, 40, "e", "f"), (1, 60, "g", "h"), (3, 1, "x", "y")], "id bigint, start int, begin string, stop string")
    p = spark.createDataFrame([(1, 0, "far"), (1, 55, "near")], "id bigint, start int, label string")
    got = rows(SP.incidents(c, d, p, p.where("false"), "id"))
    assert got == [(1, 50, 60, "caseCount", 12, "e", "f", "near", None), (2, 0, 8, "deathCount", 7, None, None, None, None)]


def test_best_cover_equals_brute_force():
    r = random.Random(4)
    for _ in range(200):
        s = [(a := r.randrange(20), a + r.randrange(1, 8), "x") for _ in range(r.randrange(0, 8))]
        apart = lambda c: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))
        best = max(sum(x[1] - x[0] for x in c) for n in range(len(s) + 1) for c in itertools.combinations(s, n) if apart(c))
        got = [s[j] for j in SP.best_cover(s)]
        assert apart(got) and sum(x[1] - x[0] for x in got) == best


def test_both_ways_of_matching_a_lexicon_agree(spark, monkeypatch):
    r = random.Random(2)
    words = ["flu", "Flu", "FLU", "bird", "http://a.b/flu.", "été", "x_1", "²", "İs", "of", "the"]
    docs = [(i, " ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(r.randrange(0, 60)))) for i in range(60)] + [(90, None), (91, "")]
    d = spark.createDataFrame(docs, "id bigint, t string")
    k = spark.createDataFrame([("bird flu", "x", False), ("FLU", "y", True), ("of the été flu", "x", False), ("²", "x", False), ("a b c d e f", "x", False), ("", "x", False), (None, "x", False)], "keyword string, type string, case_sensitive boolean")
    count, spans = FE.keyword_counts(d, "id", F.col("t"), k, "keyword"), SP.keyword_spans(d, "id", F.col("t"), k)
    best = SP.keyword_spans(d, "id", F.col("t"), k, optimal=True)
    a = rows(count), rows(spans), rows(best)
    for m in (FE, SP):
        monkeypatch.setattr(m, "small_enough", lambda *x: False)
    b = rows(FE.keyword_counts(d, "id", F.col("t"), k, "keyword")), rows(SP.keyword_spans(d, "id", F.col("t"), k)), rows(SP.keyword_spans(d, "id", F.col("t"), k, optimal=True))
    assert a == b and len(a[0]) > 20 and len(a[1]) > 40


@pytest.mark.parametrize("optimal", [False, True])
def test_a_large_lexicon_meets_only_likely_runs_in_bounded_batches(spark, monkeypatch, optimal):
    """Every token of every text once came out as a row, 10,000 texts at a time in one task's memory."""
    monkeypatch.setattr(SP, "small_enough", lambda *x: False)
    sent = []
    kind = type(spark.range(1))
    whole = kind.mapInArrow

    def spied(self, f, schema, *more):
        sent.append((f, whole(self, f, schema, *more)))
        return sent[-1][1]

    monkeypatch.setattr(kind, "mapInArrow", spied)
    monkeypatch.setattr(SP, "ROWS", 50, raising=False)
    d = spark.createDataFrame([(i, "Bird  Flu " * (i % 3) + "word nothing other " * 300) for i in range(90)], "id bigint, t string")
    k = spark.createDataFrame([("bird flu", "x", False)], "keyword string, type string, case_sensitive boolean")
    assert SP.keyword_spans(d, "id", F.col("t"), k, optimal).count() == 90
    assert sent[0][1].count() < 300
    batches = list(sent[0][0](iter([pa.RecordBatch.from_pydict({"id": [r.id for r in d.collect()], "t": ["bird flu " * 40] * 90})])))
    assert max(b.num_rows for b in batches) < 60 and sum(b.num_rows for b in batches) >= 3600


def test_trained_model_is_saved_and_loaded(spark, scratch, tmp_path):
    labels = spark.createDataFrame([("Flu", None, 1), ("Bird flu", "Flu", 2), ("Pox", None, 3)], "label string, parent_label string, row_no bigint")
    items = spark.createDataFrame([(i, "bird flu seen" if i % 2 else "pox again", ["Bird flu"] if i % 2 else ["Pox"]) for i in range(40)] + [(99, "nothing", ["Flu"])], "id bigint, t string, ds array<string>")
    m = T.trained_model(labels, items, "id", F.col("t"), F.col("ds"), f"{tmp_path}/m", scratch)
    assert [v[0] for v in A.versions(spark, f"{tmp_path}/m", "coefficients-")] == [1]
    got = {(r.id, r["class"]) for r in D.diagnose(items, "id", F.col("t"), m).collect()}
    assert (1, "Bird flu") in got and (0, "Pox") in got and (1, "Pox") not in got and not any(i == 99 for i, _ in got)


@pytest.mark.parametrize("name, most", [("annotation_features", 1), ("incident_features", 3)])
def test_features_read_the_texts_once_a_pattern(spark, name, most):
    """What several joins meet is saved; once each of them matched all the texts again."""
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= most


def test_texts_with_the_same_features_are_scored_once_by_a_trained_model(spark, scratch, tmp_path, monkeypatch):
    """Every text once got a row for every class before any was chosen."""
    labels = spark.createDataFrame([("Flu", None, 1), ("Bird flu", "Flu", 2), ("Pox", None, 3), ("Cow pox", "Pox", 4)], "label string, parent_label string, row_no bigint")
    said = ["bird flu seen", "pox again", "cow pox and flu", "flu", "nothing"]
    items = spark.createDataFrame([(i, said[i % 5], [["Bird flu", "rare"], ["Pox"], ["Cow pox", "Flu"], ["Flu", "Pox"], ["Flu"]][i % 5]) for i in range(60)], "id bigint, t string, ds array<string>")
    m = T.trained_model(labels, items, "id", F.col("t"), F.col("ds"), f"{tmp_path}/m", scratch)
    f = m.features(m.base(items, "id", F.col("t")), "id")
    each = rows(S.best_guess(S.probabilities(f, m.coefficients, m.intercepts, "id"), m.ancestors, "id"))
    read, kind = [], type(f)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, g, schema, *a: read.append(self) or whole(self, g, schema, *a))
    for dense in (True, False):
        monkeypatch.setattr(S, "small_enough", lambda *a: dense)
        got = rows(S.guesses(f, m.coefficients, m.intercepts, m.ancestors, "id", S.CUTOFF, scratch))
        assert len(got) > 60 and [x[:2] for x in got] == [x[:2] for x in each]
        assert max(abs(a[2] - b[2]) for a, b in zip(got, each)) < 1e-12
    assert [d.count() for d in read] == [4] and rows(D.diagnose(items, "id", F.col("t"), m)) == got


def test_a_trained_model_is_evaluated_without_a_row_for_every_class_of_every_text(spark, scratch, tmp_path, monkeypatch):
    labels = spark.createDataFrame([("Flu", None, 1), ("Bird flu", "Flu", 2), ("Pox", None, 3)], "label string, parent_label string, row_no bigint")
    items = spark.createDataFrame([(i, ["bird flu seen", "pox again", "flu"][i % 3], [["Bird flu"], ["Pox"], ["Flu"]][i % 3], "even" if i % 2 else "odd") for i in range(48)], "id bigint, t string, ds array<string>, part string")
    m = T.trained_model(labels, items, "id", F.col("t"), F.col("ds"), f"{tmp_path}/m", scratch)
    monkeypatch.setattr(S, "probabilities", None)
    got = {r.part: (r.labels, r.tp, r.fp, r.fn) for r in SV.evaluate(m, items, "id", F.col("t"), F.col("ds"), "part").collect()}
    assert got == {"even": (3, 32, 0, 0), "odd": (3, 32, 0, 0)}


def test_items_are_read_once_to_train_a_model_and_to_evaluate_it(spark, scratch, monkeypatch):
    """The training items' texts were once matched a second time for their scores."""
    sf, text = "/root/testdata/sf0.001", F.col("private.cleancontent.content")
    usable = CQ._items(spark, sf).where(C.is_usable() & F.col("split").isNotNull())
    apart = rows(SV.evaluate(CQ._trained(spark, sf, scratch), usable, "item_id", text, H.diseases(), "split"))
    read, whole = [], FE.keyword_counts
    monkeypatch.setattr(FE, "keyword_counts", lambda *a: read.append(a) or whole(*a))
    got = rows(E.queries()["evaluation_sets"](spark, sf))
    assert len(got) == 3 and [x[:5] for x in got] == [x[:5] for x in apart] and max(abs(a - b) for x, y in zip(got, apart) for a, b in zip(x[5:], y[5:])) < 1e-12
    assert len(read) == 1


def test_counts_of_a_large_lexicon_meet_only_likely_runs(spark, monkeypatch):
    """Every token of every text was once a row, and all of them were shuffled."""
    d = spark.createDataFrame([(i, "Bird  Flu " * (i % 3) + "word nothing other " * 300) for i in range(90)] + [(None, "flu"), (91, None)], "id bigint, t string").select(F.struct("id").alias("key"), "t")
    k = spark.createDataFrame([("bird flu",), ("flu",), ("nothing else",)], "keyword string")
    small = rows(FE.keyword_counts(d, "key", F.col("t"), k, "keyword"))
    monkeypatch.setattr(FE, "small_enough", lambda *x: False)
    sent, kind = [], type(d)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a: sent.append(whole(self, f, schema, *a)) or sent[-1])
    assert rows(FE.keyword_counts(d, "key", F.col("t"), k, "keyword")) == small and len(small) == 121
    assert sent[0].count() < 250


def test_optimal_spans_are_chosen_from_batches_of_spans(spark, monkeypatch):
    """All spans of a batch of texts once came to a task at once, gathered in sets before."""
    r = random.Random(5)
    made = [(i, r.choice("xy"), a := r.randrange(400), a + r.randrange(1, 9), r.choice("pq")) for i in range(12) for _ in range(r.randrange(200))]
    d = spark.createDataFrame(made + made[::3], "id bigint, type string, start int, end int, label string")
    sent, kind = [], type(d)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a: sent.append((self, f)) or whole(self, f, schema, *a))
    got = rows(SP.optimal_spans(d, "id"))
    want = []
    for i, k in {x[:2] for x in made}:
        own = sorted({x[2:] for x in made if x[:2] == (i, k)})
        want += [(i, k, *own[j]) for j in SP.best_cover(own)]
    assert got == sorted(want, key=repr) and len(got) > 300
    given, f = sent[0]
    assert given.columns == ["id", "type", "start", "end", "label"] and "collect_set" not in given._jdf.queryExecution().optimizedPlan().toString()
    for n in (1, 7, 1000):  # texts that go on in the next batch
        flat = pa.Table.from_pylist(sorted((dict(zip(given.columns, x)) for x in made), key=lambda x: x["id"]))
        assert sorted((tuple(x.values()) for b in f(iter(flat.to_batches(n))) for x in b.to_pylist()), key=repr) == got
