import random
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from epiquery.llm import neardup as N
from epiquery.llm import overlap as O
from epiquery.llm import textkit as K

R = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)] + ["été", "Ñandú", "вода"]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def edited(t, k):
    w = t.split()
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(VOCAB)
    return " ".join(w)


def runs(t, k=5):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= 20 else None


def brute(data, least, ok=lambda a, b: True):
    s = [(i, x) for i, t, *_ in data if t is not None and (x := runs(t))]
    return sorted({(min(a, b), max(a, b)) for n, (a, x) in enumerate(s) for b, y in s[:n] if a != b and ok(a, b) and len(x & y) >= least * len(x | y)})


def corpus():
    base = [text(R.randrange(25, 200)) for _ in range(40)]
    data = list(enumerate(base))
    for t in base[:25]:
        for k in (1, 2, 4, 8):
            data.append((len(data), edited(t, k)))
    data += [(len(data) + i, base[0].upper() + "!") for i in range(30)]  # a big group of copies
    data += [(900, None), (901, ""), (902, "too short"), (903, text(20)), (904, " ".join(["same"] * 60)), (905, " ".join(["same"] * 80)), (906, text(20_000))]
    return data


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_pairs_equal_brute_force(spark, scratch, least):
    data = corpus()
    df = spark.createDataFrame(data + data[:3], "i bigint, t string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(1))
    pairs, copies, _ = N.similar_pairs(N.signatures(df, F.col("i"), F.col("t"), F.lit(0)), scratch, least)
    got = N.all_pairs(pairs, copies)
    assert [tuple(r) for r in got.orderBy("item_id_a", "item_id_b").collect()] == brute(data, least)


def test_empty(spark, scratch):
    df = spark.createDataFrame([], "i bigint, t string")
    p, c, _ = N.similar_pairs(N.signatures(df, F.col("i"), F.col("t"), F.lit(0)), scratch, 0.5)
    assert N.all_pairs(p, c).count() == 0 and N.components(p, scratch).count() == 0


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_index_shows_the_guaranteed_minimum(t):
    """Of any two sets that are like enough, in whatever order, the indexed parts have at least the guaranteed number in common."""
    r, tight = random.Random(3), 0
    for _ in range(4000):
        x = r.randrange(1, 60)
        common = r.randrange(1, x + 1)
        y = common + r.randrange(0, 30)
        if common < t * (x + y - common) - 1e-9:
            continue
        order = list(range(x + y - common))
        r.shuffle(order)
        rank = {e: n for n, e in enumerate(order)}
        a, b = sorted(range(x), key=rank.get), sorted([*range(common), *range(x, x + y - common)], key=rank.get)
        shown, least = len(set(a[: N.indexed(x, t)]) & set(b[: N.indexed(y, t)])), N.guaranteed(x, y, t)
        assert shown >= least >= 1
        tight += shown == least
    assert tight > 10


@pytest.mark.parametrize("window", [500, 4_000_000])
def test_frequent_runs_come_last_and_miss_nothing(spark, scratch, monkeypatch, window):
    """Texts that are mostly one frequent notice still meet, in the cells of the runs that are split."""
    monkeypatch.setattr(N, "VERY", 0.1)
    monkeypatch.setattr(N, "WINDOW", window)
    notice = text(60)
    data = [(i, notice + " " + text(10 + i % 25)) for i in range(60)] + [(100 + i, text(40)) for i in range(40)]
    df = spark.createDataFrame(data, "i bigint, t string")
    r = N.signatures(df, F.col("i"), F.col("t"), F.lit(0))
    base, frequent = r.read(scratch)
    assert base.count() == 100 and frequent.split.sum() >= 56
    post = list(N._postings(N.Parts(5, 20, frequent), 0.5)(iter(df.selectExpr("i AS id", "0 AS side", "t AS text").toArrow().to_batches())))
    assert sum(b.num_rows for b in post) > 0 and any(c for b in post for c in b.column(1).to_pylist())
    pairs, copies, _ = N.similar_pairs(r, scratch, 0.5)
    got = [tuple(x) for x in N.all_pairs(pairs, copies).orderBy("item_id_a", "item_id_b").collect()]
    assert got == brute(data, 0.5) and len(got) > 1000


def test_repeated_ids_are_one_record(spark, scratch):
    t = text(50)
    df = spark.createDataFrame([(1, t), (1, edited(t, 1)), (2, t), (2, t)], "i bigint, t string")
    pairs, copies, _ = N.similar_pairs(N.signatures(df, F.col("i"), F.col("t"), F.lit(0)), scratch, 0.5)
    assert rows(N.all_pairs(pairs, copies)) == [(1, 2)]


def test_words_match_the_definition():
    t = ["Ab,c 12_x", "été́ — Ⅷ²", "", "𝒜bc 漢字"]
    _, s, e, first = K.words(t)
    cp, starts = K.joined([x.lower() for x in t])
    whole = "".join(map(chr, cp))
    import unicodedata

    for n, x in enumerate(t):
        want = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in x.lower()).split()
        assert [whole[s[j] : e[j]] for j in range(first[n], first[n + 1])] == want


def test_components(spark, scratch):
    p = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 10), (7, 7)], "a bigint, b bigint")
    assert {r.id: r.group_id for r in N.components(p, scratch).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8}


def test_split_overlap(spark, scratch):
    data = [(i, t, f" Name{i % 60} " if i % 7 else None, R.choice(["training", "mixed_test", "time_offset_test", None, "other"])) for i, t in corpus()]
    df = spark.createDataFrame(data, "i bigint, t string, name string, split string")
    got = O.overlap_pairs(df, "i", F.col("name"), F.col("t"), F.col("split"), scratch, 0.5)
    side = {i: 0 if s == "training" else 1 if s in O.EVALUATION else None for i, _, _, s in data}
    name = {i: n.strip().lower() if n else None for i, _, n, _ in data}
    cross = lambda a, b: {side[a], side[b]} == {0, 1}
    want = set(brute(data, 0.5, cross)) | {(min(a, b), max(a, b)) for a in side for b in side if a < b and cross(a, b) and name[a] and name[a] == name[b]}
    assert set(rows(got)) == want and got.count() == len(want)
    counts = O.exact_overlap_counts(df.withColumn("source", F.lit("s")), "i", F.col("t"), F.col("split"), F.col("source"))
    assert counts.agg(F.sum("rows")).first()[0] == sum(s == 1 for s in side.values())
    assert O.overlap_pairs(df.where("false"), "i", F.col("name"), F.col("t"), F.col("split"), scratch).count() == 0


def test_overlap_counts(spark, scratch):
    t = text(60)
    data = [(1, "training", "a", "n1", t), (2, "mixed_test", "a", "n2", edited(t, 1)), (3, "mixed_test", "a", " N1 ", text(60)), (4, "mixed_test", "a", "n4", text(60)),
            (5, "time_offset_test", None, "n5", t.upper()), (6, "training", "b", "n6", "too short"), (7, "mixed_test", "b", None, "Too short!"), (8, None, "b", "n1", t)]
    df = spark.createDataFrame(data, "i bigint, split string, source string, name string, t string")
    got = O.overlap_counts(df, "i", F.col("name"), F.col("t"), F.col("split"), F.col("source"), scratch, 0.5)
    assert rows(got.select("split", "source", "rows", "leaked", "exact", "pairs")) == [("mixed_test", "a", 3, 2, 0, 2), ("mixed_test", "b", 1, 1, 1, 0), ("time_offset_test", None, 1, 1, 1, 1)]
