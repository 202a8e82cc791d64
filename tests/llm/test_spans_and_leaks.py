import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epiquery.llm import leakage as L
from epiquery.llm import sharedspans as S

R = random.Random(8)


def letters(n):
    return "".join(R.choice("abcdefghij éü漢😀") for _ in range(n))


def brute_cover(data, least):
    """id -> covered positions, by all windows of `least` characters."""
    seen = {}
    for n, (i, t) in enumerate(data):
        for p in range(len(t or "") - least + 1):
            seen.setdefault(t[p : p + least], set()).add(i)
    out = {}
    for i, t in data:
        c = {q for p in range(len(t or "") - least + 1) if len(seen[t[p : p + least]]) > 1 for q in range(p, p + least)}
        if c:
            out[i] = c
    return out


def corpus():
    shared = [letters(n) for n in (199, 200, 201, 260, 700)]
    data = [(i, letters(R.randrange(0, 900))) for i in range(40)]
    for i in range(40, 80):
        data.append((i, letters(R.randrange(0, 300)) + R.choice(shared) + letters(R.randrange(0, 300)) + (R.choice(shared) if i % 3 else "")))
    hot = letters(230)
    data += [(100 + i, letters(150) + hot + letters(90)) for i in range(S.HOT + 20)]
    twice = letters(400)
    data += [(300, shared[4]), (301, shared[4]), (302, None), (303, ""), (304, twice + twice), (305, letters(100_000) + shared[3])]
    return data


def test_spans_equal_brute_force(spark, scratch):
    data = corpus()
    df = spark.createDataFrame(data + data[:2], "i bigint, t string").withColumn("id", F.lit("clash")).withColumn("text", F.lit("x"))
    s = S.SharedSpans(df, F.col("i"), F.col("t"), scratch)
    assert s.any_hot
    want = brute_cover(data, 200)
    assert {r.id for r in s.found().collect()} == set(want)
    got = {}
    for r in s.spans().collect():
        got.setdefault(r.id, set()).update(range(r.start, r.end))
    assert got == want


def test_no_rows(spark, scratch):
    s = S.SharedSpans(spark.createDataFrame([], "i bigint, t string"), F.col("i"), F.col("t"), scratch)
    assert s.found().count() == 0 and s.spans().count() == 0


WORDS = [f"v{i}" for i in range(60)] + ["12", "7.5", "km", "Étude"]


def words(n):
    return [R.choice(WORDS) for _ in range(n)]


def brute_leaks(docs, items, least):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = {}
    for e, t in items:
        x = w(t)
        for k in range(len(x) - least + 1):
            runs.setdefault(tuple(x[k : k + least]), set()).add(e)
    return {(d, e) for d, t in docs for x in [w(t)] for k in range(len(x) - least + 1) for e in runs.get(tuple(x[k : k + least]), ())}


@pytest.mark.parametrize("plan", ["broadcast", "shuffled", "split templates"])
def test_leaks_equal_brute_force(spark, scratch, plan, monkeypatch):
    if plan != "broadcast":
        monkeypatch.setattr(L, "small_enough", lambda *a: False)
    if plan == "split templates":
        monkeypatch.setattr(L, "HOT", 1)
    items = [(i, " ".join(words(R.randrange(0, 80)))) for i in range(30)] + [(98, None), (99, "")]
    docs = [(1000, None), (1001, ""), (1002, items[0][1])]
    for i in range(60):
        src = (items[i % 30][1] or "").split()
        k = R.randrange(0, max(1, len(src) - 10))
        part = src[k : k + R.choice([12, 19, 20, 21, 40])]
        docs.append((i, " ".join(words(R.randrange(0, 50)) + [x.upper() + R.choice(["", ",", " -"]) for x in part] + words(30))))
    d = spark.createDataFrame(docs + docs[:2], "i bigint, t string").withColumn("id", F.lit("clash"))
    e = spark.createDataFrame(items, "j bigint, t string")
    args = (d, F.col("i"), F.col("t"), e, F.col("j"), F.col("t"), scratch)
    got = L.leaked(*args)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(docs, items, 20)
    assert L.leaked(d.where("false"), *args[1:]).count() == 0 and L.leaked(*args[:3], e.where("false"), *args[4:]).count() == 0


def test_reparameterised(spark, scratch):
    frame = "in the town of {a} some {n} people fell ill after the rains and the clinic of {a} counted {m} more by the end of the week while the river near {b} rose and the market of {b} closed for days"
    items = [(1, frame.format(a="Rome", b="Oslo", n=12, m=30)), (2, frame.format(a="Bern", b="Kyiv", n=1, m=2))]
    docs = [(1, frame.format(a="Lima", b="Cairo", n=99, m=4)), (2, frame.format(a="Lima", b="Cairo", n=99, m=4).replace("clinic of Lima", "clinic of Paris")), (3, items[0][1])]
    d, e = spark.createDataFrame(docs, "i bigint, t string"), spark.createDataFrame(items * 1, "i bigint, t string")
    got = L.leaked(d, F.col("i"), F.col("t"), e, F.col("i"), F.col("t"), scratch, len(frame.split()) - 1, "consistent")
    assert [(r[0], r[1]) for r in rows(got)] == [(1, 1), (1, 2), (3, 2)]


@pytest.mark.parametrize("hot", [64, 1])
def test_reparameterised_items_are_found(spark, scratch, monkeypatch, hot):
    """Evaluation items with other numbers and names put in throughout: nine of ten come out, for the right item."""
    monkeypatch.setattr(L, "HOT", hot)
    items = spark.read.parquet("/root/testdata/sf0.1/eval_item.parquet").where("text is not null")
    names = ["Bavor", "Quilmo", "Tesset", "Urbano", "Wexley", "Yandri", "Zorvak", "Kelbin", "Ormond", "Pastiv"]
    common, docs = set(L.vocabulary(items, F.col("text"))) | set(L.UNITS), []
    for r in items.collect():
        w, new = r.text.split(), {}
        if len(re.findall(r"[^\W_]+", r.text)) < 45 or len(docs) == 150:
            continue
        out = []
        for n, x in enumerate(w):
            m = re.fullmatch(r"(\W*)(\d+|[A-Z][a-z]+)(\W*)", x)
            if m and m[2].lower() not in common:
                new.setdefault(m[2], str(1000 + 7 * len(new)) if m[2].isdigit() else R.choice(names) + "abcdefghijklmnopqrstuvwxyz"[len(new) % 26] * (1 + len(new) // 26))
                x = m[1] + new[m[2]] + m[3]
            out.append(x)
        if new:
            docs.append((r.item_id, " ".join(out)))
    d = spark.createDataFrame(docs, "i bigint, t string")
    got = L.leaked(d, F.col("i"), F.col("t"), items, F.col("item_id"), F.col("text"), scratch, 40, "consistent")
    found = {r.doc_id for r in got.where("doc_id = item_id and changed > 0").collect()}
    assert len(docs) > 60 and len(found) >= 0.9 * len(docs), (len(found), len(docs))


def test_bloom_filter_loses_nothing():
    import numpy as np

    from epiquery.llm import textkit as K

    b, x = L.Bloom(1000), K.splitmix(np.arange(3000))
    b.add(x[:1000])
    assert b.holds(x[:1000]).all() and b.holds(x[1000:]).mean() < 0.02


def test_patterns_tell_equal_fillings():
    import numpy as np

    fill = np.array([7, 0, 7, 9, 5, 0, 5, 8, 5, 5], dtype=np.uint64)
    a, b, c = L.patterns(fill, np.array([0, 4, 6]), 4)
    assert a == b != c


@pytest.mark.parametrize("x, y, want", [([1, 2, 1, 3], [5, 6, 5, 7], (4, 4)), ([1, 2, 1, 3], [5, 6, 8, 7], (3, 3)), ([1, 2], [1, 2], (0, 0))])
def test_consistency(x, y, want):
    assert L._consistency(x, y, 2) == want


def test_winnowing_takes_the_rightmost_minimum_in_spans_too(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    for t in range(200):
        n, w = int(r.integers(1, 300)), int(r.integers(1, 40))
        h, valid = r.integers(0, 6 if t % 2 else 2**20, n).astype(np.uint64) << np.uint64(S.INDEX), r.random(n) < 0.8
        want = sorted({i + w - 1 - int(np.argmin(h[i : i + w][::-1])) for i in range(n - w + 1) if valid[i]})
        assert S.winnow(h, valid, w).tolist() == want
        monkeypatch.setattr(S, "SPAN", 37)
        assert S.winnow(h, valid, w).tolist() == want
        monkeypatch.undo()
