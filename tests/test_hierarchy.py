import random

import pytest
from conftest import rows

from epiquery.operators import hierarchy as H


@pytest.fixture(autouse=True, params=["one task", "rounds"])
def way(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(H, "LOCAL", -1)
        monkeypatch.setattr(H, "BLOCK", 7)


def brute(table):
    """label -> (root, depth) by following parents one by one."""
    parent, labels = {}, set()
    for label, up, _ in sorted(table, key=lambda r: r[2]):
        label, up = (label or "").strip(), (up or "").strip()
        if label:
            labels.add(label)
            if up:
                parent[label] = up
    out = {}
    for x in labels | set(parent.values()):
        seen, y = [], x
        while y in parent and y not in seen:
            seen.append(y)
            y = parent[y]
        out[x] = (min(seen[seen.index(y) :]), -1) if y in seen else (y, len(seen))
    return out


def resolve(spark, scratch, table):
    df = spark.createDataFrame(table, "label string, parent string, o bigint")
    edges = scratch.save(H.with_missing_parents(scratch.save(H.parent_edges(df, "label", "parent", "o"))))
    return edges, scratch.save(H.peel_hierarchy(edges, scratch))


CASES = {
    "empty": [],
    "nulls and blanks": [(None, "a", 1), ("  ", "a", 2), (" b ", " a\t", 3), ("a", "", 4), ("c", None, 5)],
    "last parent counts": [("a", "x", 1), ("a", "y", 2), ("a", None, 3), ("a", "y", 2)],
    "self": [("a", "a", 1), ("b", "a", 2)],
    "cycle and tail": [("b", "c", 1), ("c", "d", 2), ("d", "b", 3), ("t", "b", 4), ("u", "t", 5), ("z", "r", 6)],
    "only cycles": [("b", "a", 1), ("a", "b", 2)],
    "long chain": [(f"n{i:04d}", f"n{i + 1:04d}", i) for i in range(300)],
    "wide": [(f"k{i}", "top", i) for i in range(500)] + [("top", "root", 501)],
}


@pytest.mark.parametrize("name", CASES)
def test_roots_and_depths(spark, scratch, name):
    _, got = resolve(spark, scratch, CASES[name])
    assert {r.label: (r.root_label, r.depth) for r in got.collect()} == brute(CASES[name])


def test_random_forests(spark, scratch):
    r = random.Random(4)
    table = [(f"x{r.randrange(120)}", f"x{r.randrange(120)}" if r.random() < 0.9 else None, i) for i in range(200)]
    _, got = resolve(spark, scratch, table)
    assert {x.label: (x.root_label, x.depth) for x in got.collect()} == brute(table)


def test_sizes_and_deep_branches(spark, scratch):
    table = [(f"a{i:03d}", f"a{i + 1:03d}", i) for i in range(90)] + [(f"b{i:03d}", f"a{2 * i + 1:03d}", 100 + i) for i in range(40)] + [(f"c{i}", "b007", 200 + i) for i in range(5)]
    _, got = resolve(spark, scratch, table)
    parent = {x: p for x, p, _ in table}
    size = {}
    for x in set(parent) | set(parent.values()):
        while x is not None:
            size[x] = size.get(x, 0) + 1
            x = parent.get(x)
    assert {r.label: r["size"] for r in got.collect()} == size


def test_paths_and_descendants(spark, scratch):
    edges, got = resolve(spark, scratch, [("a", "b", 1), ("b", "c", 2), ("d", "b", 3), ("e", "e", 4)])
    pairs = H.ancestor_pairs(edges, got, scratch)
    assert rows(pairs) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("d", "b", 1), ("d", "c", 2)]
    paths = {r.label: (r.path, r.n_descendants) for r in H.hierarchy_paths(edges, got, pairs).collect()}
    assert paths == {"a": ("c > b > a", 0), "b": ("c > b", 2), "c": ("c", 3), "d": ("c > b > d", 0), "e": (None, 0)}


def test_clashing_columns(spark, scratch):
    df = spark.createDataFrame([("a", "b", 1, "x", "y")], "label string, parent_label string, row_no bigint, ptr string, dist string")
    edges = H.with_missing_parents(H.parent_edges(df, "label", "parent_label", "row_no"))
    assert rows(H.peel_hierarchy(edges, scratch).select("label", "root_label", "depth")) == [("a", "b", 1), ("b", "b", 0)]


def test_descendants_below_cycles(spark, scratch):
    edges, got = resolve(spark, scratch, [("A", "B", 1), ("B", "A", 2), ("C", "A", 3), ("D", "C", 4), ("E", "D", 5), ("s", "s", 6), ("t", "s", 7), ("u", "r", 8)])
    pairs = H.ancestor_pairs(edges, got, scratch, below_cycles=True)
    assert rows(pairs) == [("C", "A", 1), ("D", "A", 2), ("D", "C", 1), ("E", "A", 3), ("E", "C", 2), ("E", "D", 1), ("t", "s", 1), ("u", "r", 1)]
    paths = {r.label: (r.path, r.n_descendants) for r in H.hierarchy_paths(edges, got, H.ancestor_pairs(edges, got, scratch)).collect()}
    assert paths == {"A": (None, 3), "B": (None, 0), "C": (None, 2), "D": (None, 1), "E": (None, 0), "s": (None, 1), "t": (None, 0), "r": ("r", 1), "u": ("r > u", 0)}


def implied(table):
    """label -> {label met: least distance}, by following parents one by one."""
    parent = {}
    for label, up, _ in sorted(table, key=lambda r: r[2]):
        label, up = (label or "").strip(), (up or "").strip()
        if label and up:
            parent[label] = up
    out = {}
    for x in parent:
        met, y, n = {}, x, 0
        while y in parent and parent[y] not in met:
            y, n = parent[y], n + 1
            met[y] = n
        out[x] = met
    return {(x, y, n) for x, met in out.items() for y, n in met.items()}


@pytest.mark.parametrize("name", [*CASES, "ring of 40 and short trees", "random"])
def test_implied_labels(spark, scratch, name):
    r = random.Random(8)
    more = {"ring of 40 and short trees": [(f"r{i:02d}", f"r{(i + 1) % 40:02d}", i) for i in range(40)] + [("s", "t", 50), ("u", "r03", 51)], "random": [(f"x{r.randrange(90)}", f"x{r.randrange(90)}", i) for i in range(150)]}
    table = (CASES | more)[name]
    edges = H.with_missing_parents(H.parent_edges(spark.createDataFrame(table, "label string, parent string, o bigint"), "label", "parent", "o"))
    got = rows(H.inferred_pairs(edges, scratch))
    assert len(got) == len(set(got)) and set(got) == implied(table)
