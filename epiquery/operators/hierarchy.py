"""Parent-child rows to full hierarchies, by peeling leaves from the bottom up.

A round peels all leaves and sends their subtree sizes to their parents; the reverse order of the rounds assigns roots and depths; what
no round peels lies on a cycle. Forests of at most LOCAL nodes (a checked bound) are peeled round by round in one task, in numpy. Larger
ones are peeled in distributed rounds, and as a very long chain would take one for each level, such a round peels whole leaf chains:
every leaf with the nodes above it that have no other child left. The ends of the chains are found by pointer jumps (log of the chain's
length), sizes along a chain are summed up in blocks, so no task ever holds a whole chain, and the number of rounds is at most the
logarithm of the number of leaves, however deep the trees are. Both ways give the same rows.

``inferred_pairs`` gives the labels that a label implies (its ancestors, round cycles too), for the label model and corpus queries.

Defined results: null and blank labels name no node; blanks around labels and parents are ignored; of several rows the
last (highest order) with a non-empty parent counts; a parent without a row is a node and, having no parent, a root;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: nodes of a forest that one task may hold (some 200 bytes each), and nodes of a chain that are summed up in one go
LOCAL, BLOCK = 1_000_000, 4096
_BLANKS = r"^\s+|(?<!\s)\s+$"


def trimmed(c: Column) -> Column:
    """Text without surrounding white space; null if nothing is left."""
    t = F.regexp_replace(c, _BLANKS, "")
    return F.when(t != "", t)


def parent_edges(rows: DataFrame, label: str, parent: str, order: str) -> DataFrame:
    """(label, parent): one row per non-empty label, the parent of its last row that has one."""
    r = rows.select(trimmed(F.col(label)).alias("label"), trimmed(F.col(parent)).alias("parent"), F.col(order).alias("o"))
    return r.where("label is not null").groupBy("label").agg(F.max(F.when(F.col("parent").isNotNull(), F.struct("o", "parent")))["parent"].alias("parent"))


class Forest:
    """A forest in memory: labels and the place of each one's parent, -1 for none. Parents that have no row are added as nodes."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        parts = list(batches)
        own, up = (pa.chunked_array([b.column(c) for b in parts], pa.string()).combine_chunks() for c in (0, 1))
        missing = pc.unique(up.filter(pc.invert(pc.or_kleene(pc.is_null(up), pc.is_in(up, value_set=own)))))
        self.labels = pa.concat_arrays([own, missing.cast(pa.string())])
        self.own = len(own)
        at = pc.fill_null(pc.index_in(up, value_set=self.labels), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.parent = np.concatenate([at, np.full(len(missing), -1)])

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Root, depth, whether on a cycle, and subtree size of every node."""
        up, n = self.parent, len(self.parent)
        children, size = np.bincount(up[up >= 0], minlength=n), np.ones(n, dtype=np.int64)
        rounds, leaves = [], np.flatnonzero(children == 0)
        while len(leaves):
            rounds.append(leaves)
            sent = leaves[up[leaves] >= 0]
            np.add.at(size, up[sent], size[sent])
            np.subtract.at(children, up[sent], 1)
            above = np.unique(up[sent])
            leaves = above[children[above] == 0]
        cyclic = children > 0
        root, depth = np.arange(n), np.where(cyclic, -1, 0)
        todo = set(np.flatnonzero(cyclic).tolist())
        while todo:
            ring = [todo.pop()]
            while (x := int(up[ring[-1]])) != ring[0]:
                ring.append(x)
                todo.discard(x)
            root[ring] = min(ring, key=lambda x: self.labels[x].as_py())
        for leaves in reversed(rounds):
            above = up[leaves]
            top = above < 0
            root[leaves] = np.where(top, leaves, root[above])
            depth[leaves] = np.where(top, 0, np.where(depth[above] < 0, -1, depth[above] + 1))
        return root, depth, cyclic, size

    def ways(self, start: np.ndarray, ends: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(nodes, the nodes met, steps): the ways up from `start`, until a root, or a node of `ends` is met."""
        at, steps = start, 0
        while len(start):
            at = self.parent[at]
            keep = at >= 0
            start, at, steps = start[keep], at[keep], steps + 1
            if len(start):
                yield start, at, steps
            if ends is not None:
                on = ~ends[at]
                start, at = start[on], at[on]


_RESOLVED = "label string, root_label string, depth bigint, in_cycle boolean, size bigint, own boolean"
_PAIRS = "label string, ancestor string, distance bigint"


def _in_one_task(edges: DataFrame, work: Callable[[Forest], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest(batches)
        if len(f.labels):
            yield from work(f)

    return edges.select("label", "parent").coalesce(1).mapInArrow(rows, schema)


def _resolved(f: Forest) -> Iterator[pa.RecordBatch]:
    root, depth, cyclic, size = f.peel()
    yield pa.RecordBatch.from_arrays([f.labels, f.labels.take(pa.array(root)), pa.array(depth, pa.int64()), pa.array(cyclic), pa.array(size), pa.array(np.arange(len(root)) < f.own)], names=["label", "root_label", "depth", "in_cycle", "size", "own"])


def _pair_rows(f: Forest, nodes: np.ndarray, met: np.ndarray, steps: int | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([f.labels.take(pa.array(nodes)), f.labels.take(pa.array(met)), pa.array(np.broadcast_to(steps, nodes.shape), pa.int64())], names=["label", "ancestor", "distance"])


def _ancestors(below_cycles: bool):
    def work(f: Forest) -> Iterator[pa.RecordBatch]:
        _, depth, cyclic, _ = f.peel()
        start = np.flatnonzero((depth != 0) & ~cyclic if below_cycles else depth > 0)
        for nodes, met, steps in f.ways(start, cyclic):
            yield _pair_rows(f, nodes, met, steps)

    return work


def _implied(f: Forest) -> Iterator[pa.RecordBatch]:
    _, depth, cyclic, _ = f.peel()
    for nodes, met, steps in f.ways(np.flatnonzero(depth > 0), None):
        yield _pair_rows(f, nodes, met, steps)
    for x in np.flatnonzero(depth < 0).tolist():
        way, seen = [int(f.parent[x])], set()
        while way[-1] not in seen:
            seen.add(way[-1])
            way.append(int(f.parent[way[-1]]))
        yield _pair_rows(f, np.full(len(way) - 1, x), np.array(way[:-1]), np.arange(1, len(way)))


def _jump(active: DataFrame, state: DataFrame) -> DataFrame:
    """One doubling: every active node's pointer moves to its pointer's pointer."""
    nxt = state.select(F.col("label").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
    return active.join(nxt, "ptr").select("label", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))


def ancestor_pairs(edges: DataFrame, resolved: DataFrame, scratch: Scratch, below_cycles: bool = False) -> DataFrame:
    """(label, ancestor, distance) for every acyclic label and each of its ancestors, with four times the distance per round.

    With below_cycles also for labels below a cycle, up to the first label on it: a label on a cycle is the ancestor of the trees
    that hang from it, and has no ancestors itself, so it descends from none and no way round the cycle counts."""
    if edges.count() <= LOCAL:
        return _in_one_task(edges, _ancestors(below_cycles), _PAIRS)
    ok = resolved.where("depth != 0 and not in_cycle" if below_cycles else "depth > 0").select("label")
    full = scratch.save(edges.join(ok, "label").select("label", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")))
    reach, far = 1, full

    def further(far: DataFrame, known: DataFrame) -> DataFrame:
        steps = known.select(F.col("label").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("distance").alias("d2"))
        return far.join(steps, "ancestor").select("label", F.col("a2").alias("ancestor"), (F.col("distance") + F.col("d2")).alias("distance"))

    while True:
        once = further(far, full)
        twice = further(once.where(F.col("distance") == 2 * reach), full.unionByName(once))
        new = scratch.save(once.unionByName(twice))
        if new.isEmpty():
            return full
        reach *= 4
        full, far = full.unionByName(new), new.where(F.col("distance") == reach)


def inferred_pairs(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, ancestor, distance): every label met by following parents from a label, at its least distance.

    A label on a cycle meets all labels of the cycle, itself too; one below a cycle meets those of the way and of the cycle. Distances
    grow fourfold a round. Labels whose way never ends stay active for ever; all others are done once a round ends none, and
    those go on until each has met a label twice. No group is larger than the way of one label."""
    if edges.count() <= LOCAL:
        return _in_one_task(edges, _implied, _PAIRS)
    full = scratch.save(edges.where("parent is not null").select("label", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")))
    reach, far, active = 1, full, None

    def further(far: DataFrame, known: DataFrame) -> DataFrame:
        steps = known.select(F.col("label").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("distance").alias("d2"))
        return far.join(steps, "ancestor").select("label", F.col("a2").alias("ancestor"), (F.col("distance") + F.col("d2")).alias("distance"))

    while True:
        once = further(far, full)
        new = scratch.save(once.unionByName(further(once.where(F.col("distance") == 2 * reach), full.unionByName(once))))
        reach *= 4
        full, far = full.unionByName(new), new.where(F.col("distance") == reach)
        left = far.count()
        if not left:
            return full
        if left == active:
            ways = full.join(far.select("label"), "label", "left_semi").groupBy("label").agg(F.count_distinct("ancestor").alias("n"))
            if ways.where(F.col("n") == reach).isEmpty():
                return full.groupBy("label", "ancestor").agg(F.min("distance").alias("distance"))
        active = left


def hierarchy_paths(edges: DataFrame, resolved: DataFrame, pairs: DataFrame, separator: str = " > ") -> DataFrame:
    """(label, root_label, depth, path, n_descendants). path runs from the root to the label and is null in or below a cycle;
    a path has depth + 1 entries, so no group is larger than the tree is deep. n_descendants is the peeled size without the label
    itself: for a label on a cycle, the trees that hang from it."""
    up = pairs.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False).alias("up"))
    path = F.when(F.col("depth") >= 0, F.concat_ws(separator, F.coalesce(F.col("up")["ancestor"], F.array().cast("array<string>")), "label"))
    return resolved.join(up, "label", "left").select("label", "root_label", "depth", path.alias("path"), (F.col("size") - 1).alias("n_descendants"))


def with_missing_parents(edges: DataFrame) -> DataFrame:
    """edges plus a row (parent, null) for each parent without a row of its own."""
    extra = edges.where("parent is not null").select(F.col("parent").alias("label")).distinct().join(edges.select("label"), "label", "left_anti")
    return edges.unionByName(extra, allowMissingColumns=True)


def _hops(left: DataFrame, known: DataFrame | None) -> DataFrame:
    """Two jumps of the unfinished nodes; finished ones among them stay as they are."""
    with_known = lambda d: d if known is None else known.unionByName(d)
    once = _jump(left, with_known(left))
    return once.where("done").unionByName(_jump(once.where("not done"), with_known(once)))


def _chains(active: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, int]:
    """(label, leaf, height) of the nodes of all leaf chains of the active nodes (label, parent), and their number."""
    kids = active.where("parent is not null").groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("n"), F.max("label").alias("child"))
    t = active.join(kids, "label", "left").where("n is null or n = 1")
    leaf = F.col("n").isNull()
    # a pointer at a node with several children meets nothing and ends its row
    start = t.select("label", F.when(leaf, F.col("label")).otherwise(F.col("child")).alias("ptr"), F.when(leaf, 0).otherwise(1).cast("bigint").alias("dist"), F.col("label").alias("least"), leaf.alias("done"))
    once = _jump(start.where("not done"), start)
    state = scratch.save(start.where("done").unionByName(once))
    known, total = None, 0
    while True:
        n_new, n_left = state.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if n_new:
            known, total = (state.where("done") if known is None else known.unionByName(state.where("done"))), total + n_new
        if not n_new or not n_left:
            chains = None if known is None else known.select("label", F.col("ptr").alias("leaf"), F.col("dist").alias("height"))
            return chains, total
        state = scratch.save(_hops(state.where("not done"), known))


def peel_hierarchy(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (label, parent or null), labels unique -> (label, root_label, depth, in_cycle, size, own).

    depth is -1 and root_label the smallest label of the cycle for nodes in or below a cycle; in_cycle marks those on it. size
    counts the node and all below it (for nodes on a cycle: the node and the trees that hang from it). own: the node has a row."""
    if edges.count() <= LOCAL:
        return _in_one_task(edges, _resolved, _RESOLVED)
    full = scratch.save(with_missing_parents(edges.withColumn("own", F.lit(True))))
    done = _peel_in_rounds(full.select("label", "parent"), scratch)
    return done.join(full.select("label", F.coalesce("own", F.lit(False)).alias("own")), "label").select("label", "root_label", "depth", "in_cycle", "size", "own")


def _peel_in_rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    active = scratch.save(edges.select("label", "parent", F.lit(1).cast("bigint").alias("size")))
    rounds, left = [], active.count()
    while left:
        chains, n = _chains(active, scratch)
        if not n:
            break
        links = scratch.save(chains.join(active, "label").selectExpr("label", "parent", "leaf", "height", "size AS own", f"height div {BLOCK} AS block"))
        blocks = links.groupBy("leaf", "block").agg(F.sum("own").alias("all")).selectExpr("leaf", "block", "sum(all) OVER (PARTITION BY leaf ORDER BY block) - all AS before")
        peeled = scratch.save(links.join(blocks, ["leaf", "block"]).selectExpr("label", "parent", "leaf", "height", "before + sum(own) OVER (PARTITION BY leaf, block ORDER BY height) AS size"))
        tops = peeled.groupBy("leaf").agg(F.max(F.struct("height", "label", "parent", "size")).alias("t")).select("leaf", "t.*")
        rounds.append((peeled, tops))
        sent = tops.where("parent is not null").groupBy(F.col("parent").alias("label")).agg(F.sum("size").alias("more"))
        rest = active.join(peeled.select("label"), "label", "left_anti").join(sent, "label", "left")
        active, left = scratch.save(rest.select("label", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))), left - n
    least = _least_of_cycles(active, scratch)
    known = active.join(least, "label").select("label", "root_label", F.lit(-1).cast("bigint").alias("depth"), F.lit(True).alias("in_cycle"), "size")
    for peeled, tops in reversed(rounds):
        above = known.select(F.col("label").alias("parent"), F.col("root_label").alias("up_root"), F.col("depth").alias("up"))
        base = tops.withColumnRenamed("height", "top").join(above, "parent", "left").select("leaf", "top", F.coalesce("up_root", "label").alias("root_label"), F.when(F.col("parent").isNull(), 0).when(F.col("up") < 0, -1).otherwise(F.col("up") + 1).alias("base"))
        depth = F.when(F.col("base") < 0, F.lit(-1)).otherwise(F.col("base") + F.col("top") - F.col("height")).cast("bigint")
        done = peeled.join(base, "leaf").select("label", "root_label", depth.alias("depth"), F.lit(False).alias("in_cycle"), "size")
        known = known.unionByName(scratch.save(done))
    return known


def _least_of_cycles(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, root_label) of nodes (label, parent) that all lie on cycles: the smallest label of each one's cycle."""
    n, reach = nodes.count(), 1
    state = nodes.select("label", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("dist"), F.col("parent").alias("least"), F.lit(False).alias("done"))
    while reach < n:
        state, reach = scratch.save(_jump(state, state)), reach * 2
    return state.select("label", F.col("least").alias("root_label"))
