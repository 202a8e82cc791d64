import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from epiquery.llm import boilerplate as B
from epiquery.llm import langid as G
from epiquery.llm import packing as P

SAY = {
    "en": "The health officials in the old quarter have confirmed that the number of patients is higher than last week and the source remains unknown",
    "fr": "Les autorités sanitaires de la ville ont confirmé que le nombre de malades est plus élevé que la semaine dernière et la source reste inconnue",
    "es": "Las autoridades sanitarias de la ciudad han confirmado que el número de enfermos es mayor que la semana pasada y el origen sigue siendo desconocido",
    "de": "Die Gesundheitsbehörden der Stadt haben bestätigt dass die Zahl der Kranken höher ist als in der letzten Woche und die Quelle unbekannt bleibt",
    "ru": "Медицинские власти города подтвердили что число больных выше чем на прошлой неделе однако источник пока остаётся неизвестен и врачи ждут новых анализов",
}


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    texts, labels = [], []
    for c, t in SAY.items():
        w = t.split()
        for k in range(40):
            r.shuffle(w)
            texts.append(" ".join(w[: r.randrange(10, len(w))]))
            labels.append(c if k % 8 else "en")  # one in eight is wrong
    return G.fit(texts, labels)


@pytest.mark.parametrize("label, code", [("EN", "en"), ("eng", "en"), ("English", "en"), ("en-GB", "en"), ("fr_FR", "fr"), ("es-419", "es"), ("GERMAN", "de"), ("und", None), ("xx", None), ("", None), (None, None), ("nl", None), (" ru ", "ru")])
def test_labels(label, code):
    assert G.named_language(label) == code


def test_wrong_labels(spark, model):
    quote = SAY["en"] + " «" + " ".join(SAY["fr"].split()[:3]) + "»"
    data = [(1, SAY["en"], "en"), (2, SAY["fr"], "en-GB"), (3, SAY["en"] + "\n" + SAY["de"], "EN"), (4, SAY["ru"], None), (5, "short text", "xx"), (6, None, "xx"), (7, "", "xx"), (8, quote, "eng"), (9, SAY["es"] * 500, "es"), (10, "one two\n" * 30, "xx"), (2, SAY["fr"], "en-GB")]
    df = spark.createDataFrame(data, "i bigint, t string, l string").withColumn("id", F.lit("clash")).withColumn("lang", F.lit("clash"))
    got = G.wrong_labels(df, model, F.col("i"), {"t": (F.col("t"), F.col("l"))}).distinct()
    assert {(r.id, r.lang) for r in got.collect()} == {(2, "fr"), (3, "en"), (3, "de"), (4, "ru")}
    seg = G.label_paragraphs(df, model, F.col("i"), {"t": F.col("t")}).where("id = 3").orderBy("paragraph").collect()
    assert [(r.paragraph, r.lang) for r in seg] == [(0, "en"), (1, "de")] and all(0.5 < r.confidence <= 1 for r in seg)
    assert G.wrong_labels(df.where("false"), model, F.col("i"), {"t": (F.col("t"), F.col("l"))}).count() == 0


def test_unfitted_model_has_no_preference():
    assert len(set(np.unique(G.fit([], [])))) == 1


def page(body, extra=""):
    return f"<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>Latest</a></li></ul></nav><article><h1>Head line here</h1>{body}</article>{extra}<footer><p>© All rights reserved</p></footer></body></html>"


def test_blocks():
    b, title = B.blocks("<title>A &amp; B</title><p>One<p>Two <b>bold</b> &eacute;<br>three<script>if (a<b) x()</script><table><tr><td>c1<td>c2</table>a < b<!-- <p>no</p> --></div>")
    assert [x.text for x in b] == ["One", "Two bold é", "three", "c1", "c2", "a < b"] and title == "A & B"
    assert B.blocks("")[0] == [] and B.blocks("<p></p><br>")[0] == [] and [x.text for x in B.blocks("<p>" * 5000 + "deep")[0]] == ["deep"]


def test_key():
    assert B.para_key("Été 12_x!") == B.para_key("été12x")


def test_gradients():
    r = np.random.default_rng(0)
    m = B.Labeller(width=5, hidden=3)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64) + r.standard_normal(m.p[k].shape) * 0.1
    x, mask = r.standard_normal((4, 2, 5)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], dtype=float)
    y = r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = m.predict(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for k in m.p:
        at = tuple(r.integers(0, s) for s in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-3
        up = loss()
        m.p[k][at] = old - 1e-3
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3, k


def test_main_text(spark):
    r = random.Random(3)
    say = lambda: " ".join(r.choice(SAY["en"].split()) for _ in range(20)).capitalize() + f" {r.random()}."
    sample, held = [], []
    for n in range(160):
        ps = [say() for _ in range(r.randrange(1, 6))]
        tease = "".join(f"<p><a href=#>{say()[:30]}…</a></p>" for _ in range(2)) + f"<p>{say()}</p>"
        html = page("".join(f"<p>{p}</p>" for p in ps), f"<aside><h4>You may also like</h4>{tease}</aside><section><h3>Comments</h3><p>{say()}</p></section>")
        (sample if n < 130 else held).append((html, ps))
    model = B.fit([(h, ["\n".join(ps)], False) for h, ps in sample])
    got = B.label_blocks(model, [h for h, _ in held])
    found, true = Counter(), Counter()
    for n, (labelled, (_, ps)) in enumerate(zip(got, held)):
        found.update((n, t) for t, p in labelled if p >= 0.5)
        true.update((n, p) for p in ps)
    both = sum((found & true).values())
    assert both > 0.95 * sum(found.values()) and both > 0.95 * sum(true.values())
    df = spark.createDataFrame([(1, held[0][0]), (1, held[0][0]), (2, None), (3, ""), (4, "<p>" + "x " * 300_000)], "i bigint, p string").withColumn("id", F.lit("clash"))
    assert {r.para_key for r in B.paragraph_keys(df, F.col("i"), F.col("p"), model).where("id = 1").collect()} >= {B.para_key(p) for p in held[0][1][:1]}
    assert B.main_text(df.where("false"), F.col("i"), F.col("p"), model).count() == 0
    items = spark.createDataFrame([(1, held[0][1][0] + "\n© All rights reserved\n\nunseen line"), (2, None), (3, "")], "i bigint, c string").withColumn("key", F.lit(1))
    left = B.leftovers(items, F.col("i"), F.col("c"), B.notices(df, F.col("i"), F.col("p"), model, 2))
    assert rows(left) == [(1, 1, "© All rights reserved")]
    none = B.fit([])
    assert not [1 for x in B.label_blocks(none, [h for h, _ in held]) for _, p in x if p >= 0.5]


def test_leftovers_by_share_and_own_page(spark):
    class Stub:  # all but lines with © is article text, on long pages these too
        def predict(self, x, mask):
            return np.where((x[:, :, B.PATHS + B.ATTRS + B.WORDS + 6] > 0) & (mask.sum(axis=0) < 10), 0.0, 1.0)

    often, rare, mine = "© all rights", "© seen once", "quoted © words"
    pages = [(i, f"<p>text {i}<p>{often}", f"n{i}") for i in range(8)] + [(8, "<p>text" * 12 + f"<p>{often}", "n8"), (9, f"<p>a<p>{rare}", "n9")]
    pages += [(10, "<p>text" * 12 + f"<p>{mine}", "own"), (11, f"<p>a<p>{mine}", "other"), (12, None, "n9"), (13, f"<p>b<p>{mine}", None)]
    df = spark.createDataFrame(pages[:9], "i bigint, p string, name string")
    items = spark.createDataFrame([(1, f"x\n{often}", "unknown"), (2, f"y\n{rare}", "n9"), (3, f"z\n{often}\n{rare}", None), (4, f"text 1\n{mine}", "own"), (5, often, "n8")], "i bigint, c string, name string")
    found = B.leftovers(items, F.col("i"), F.col("c"), B.notices(df, F.col("i"), F.col("p"), Stub()))
    assert rows(found.select("id", "line")) == [(1, 1), (3, 1), (5, 0)]  # article text on one page of nine
    counts = B.line_counts(spark.createDataFrame(pages[:12], "i bigint, p string, name string"), F.col("i"), F.col("p"), Stub(), F.col("name"))
    keys = B.furniture(counts)
    found = B.leftovers(items, F.col("i"), F.col("c"), keys, F.col("name"), B.own_exceptions(counts, keys))
    assert rows(found.select("id", "line")) == [(1, 1), (2, 1), (3, 1), (3, 2), (5, 0)]
    assert rows(B.own_exceptions(counts, keys.where("false")).select("name", "furniture")) == [("n9", True), ("other", True)]


def brute_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_equal_best_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 101) for _ in range(r.randrange(1, 400))]
    runs = P.sweeps(dict(Counter(sizes)), 100)
    load, seen = Counter(), Counter()
    for size, lo, hi, first, each in runs:
        for k in range(lo, hi):
            load[first + (k - lo) // each] += size
            seen[size] += 1
    assert seen == Counter(sizes) and max(load.values()) <= 100 and len(load) == brute_best_fit(sizes, 100) and set(load) == set(range(len(load)))


def test_packed(spark, scratch):
    r = random.Random(2)
    data = [(i, r.choice([3, 3, 3, 40, 64, 65, 200, r.randrange(1, 64)])) for i in range(500)]
    got = P.packed(spark.createDataFrame(data + data[:2], "id bigint, tokens bigint"), scratch, 64)
    out = got.collect()
    load, total = Counter(), Counter()
    for x in out:
        load[x.container] += x.tokens
        total[x.id] += x.tokens
        assert x.tokens <= 64
    assert max(load.values()) <= 64 and sum(total.values()) == sum(n for _, n in data + data[:2]) and all(total[i] == n for i, n in data[2:])
    assert all(c == 1 for c in Counter(x.id for x in out if dict(data)[x.id] <= 64 and x.id > 1).values())
    assert P.packed(spark.createDataFrame([], "id bigint, tokens bigint"), scratch, 64).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "вода"), (5, "a " * 50_000)], "i bigint, t string").withColumn("id", F.lit("clash"))
    got = dict(rows(P.token_counts(df, F.col("i"), F.col("t"))))
    assert got[1] == 2 and set(got) == {1, 4, 5} and got[5] >= 50_000


def test_blocks_take_linear_time_and_hidden_parts_go():
    import time

    from epiquery.llm import boilerplate as B

    def took(text):
        began = time.perf_counter()
        B.blocks(text)
        return time.perf_counter() - began

    for piece in ("<!-- ", "<script>", "<a ", "x", "<p"):
        assert took(piece * (5_000_000 // len(piece))) < 12 * max(took(piece * (1_250_000 // len(piece))), 0.05)
    page = "<p>a<!-- <p>x</p> --></p><SCRIPT>if (a<b) '<p>y'</SCRIPT ><p>b</p><!-- open <p>c</p>"
    assert [b.text for b in B.blocks(page)[0]] == ["a", "b", "c"]


def test_prediction_in_spans_equals_one_run():
    import numpy as np

    from epiquery.llm import boilerplate as B

    m, x = B.Labeller(), np.random.default_rng(1).standard_normal((B.SPAN + 50, 1, B.WIDTH)).astype(np.float32)
    mask = np.ones((len(x), 1), dtype=np.float32)
    whole = m.predict(x, mask)
    try:
        B.SPAN, span = 64, B.SPAN
        assert np.allclose(m.predict(x, mask), whole, atol=1e-5)
    finally:
        B.SPAN = span


def test_containers_hold_every_text_whole(spark, scratch):
    """Over whole tables: no container above the capacity, every text complete and unsplit unless larger, and no container more than the tokens need."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = scratch.save(P.token_counts(docs, F.col("doc_id"), F.col("text")))
    got = scratch.save(P.packed(sizes, scratch))
    fill = got.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.max("t").alias("most"), F.count("*").alias("n"), F.sum("t").alias("all"), F.max("container").alias("last")).first()
    assert fill.most <= P.CAPACITY and fill.n == fill.last + 1 == -(-fill.all // P.CAPACITY)
    per = got.groupBy("id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count_distinct("start").alias("starts")).join(sizes, "id", "full")
    assert per.where(f"t is null or t != tokens or n != starts or n != ceil(tokens / {P.CAPACITY})").count() == 0
