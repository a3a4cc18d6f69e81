"""The branching of largest weight of a directed graph: a forest in which a node has one parent, or is a root.

By rounds over tables. In each, every node takes its best incoming arc, or stays a root where none is worth more. If
that closes cycles, pointers are doubled until all nodes of a cycle know it; each cycle becomes one node, whose
incoming arcs are worth what they gain over the arc that they would replace; and so on, until there is no cycle, or few
arcs are left (`FEW`): these are dealt to tasks by component, which do the same rounds on arrays, as the last rounds are many and small. Going
back, the arc that a contracted cycle has taken replaces one of its own, and the others stay.

Where all arcs weigh the same in either direction, a cycle is two nodes, and a round would add few nodes to what has grown. There the branching is
a spanning forest turned away from its roots: in each round every part takes its best edge, which leaves at most half of the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import components, cut_lineage, drop, numbered

#: Arcs from which on rounds are left to tasks, each with whole components.
FEW = 1 << 18


def _doubled(ahead: DataFrame) -> DataFrame:
    """Ways of twice the length: where they lead, and the least node on them."""
    far = ahead.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
    return ahead.join(far, "to").select("node", F.col("_to").alias("to"), F.least("low", "_low").alias("low"))


def _cycles(picks: DataFrame) -> DataFrame:
    """``node``, ``cycle``: the nodes that lie on cycles of `picks` (``node``, ``parent``), with the least node of theirs.

    A way that ends at a root drops out as ways are doubled. Where a doubling leads to as many nodes as the one before, it
    permutes them, and they are the nodes of the cycles; then their own ways are doubled until the least node is known.
    """
    ahead = cut_lineage(_doubled(picks.filter("parent IS NOT NULL").select("node", F.col("parent").alias("to"), F.least("node", "parent").alias("low"))))
    reached = -1
    while (now := ahead.select("to").distinct().count()) not in (0, reached):
        reached = now
        doubled = cut_lineage(_doubled(_doubled(ahead)))
        drop(ahead)
        ahead = doubled
    on = ahead.select(F.col("to").alias("node")).distinct()
    names = cut_lineage(on.join(ahead, "node"))
    drop(ahead)
    while reached > 1 and now:
        doubled = cut_lineage(_doubled(names).join(names.select("node", F.col("low").alias("_was")), "node"))
        drop(names)
        names = doubled.drop("_was")
        names._written_to = doubled._written_to
        if doubled.filter("low <> _was").isEmpty():
            break
    out = cut_lineage(names.select("node", F.col("low").alias("cycle")))
    drop(names)
    return out


def _last(*keys: np.ndarray, of: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of the rows with equal values of `of`, the one with the largest keys, the first key first."""
    order = np.lexsort((*reversed(keys), *reversed(of)))
    differ = np.zeros(max(0, len(order) - 1), bool)
    for c in of:
        differ |= np.diff(c[order]) != 0
    return order[np.append(differ, True)[: len(order)]]


def _rounds(node: np.ndarray, affinity: np.ndarray, into: np.ndarray, arcs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arc (its ends among the given nodes) that each node takes, and whether it takes one: the rounds of `max_branching`."""
    n = len(node)
    src, dst = np.searchsorted(node, arcs[0]), np.searchsorted(node, arcs[1])
    weight, out, land = arcs[2:]
    # the given nodes at which arcs end, and where they are
    given, where = np.unique(np.concatenate([land, into]), return_index=True)
    at = np.concatenate([dst, np.arange(n)])[where]
    affinity, into, log = affinity.copy(), into.copy(), []
    while True:
        best = _last(weight, -src, out, land, of=(dst,))
        best = best[weight[best] > affinity[dst[best]]]
        to = dst[best]
        parent, out_of, in_to, cost = np.full(n, n), np.zeros(n, np.int64), into.copy(), np.zeros(n)
        parent[to], out_of[to], in_to[to], cost[to] = src[best], out[best], land[best], weight[best]
        ahead, low = np.append(parent, n), np.minimum(np.arange(n + 1), np.append(parent, n))
        for _ in range(n.bit_length() + 1):
            ahead, low = ahead[ahead], np.minimum(low, low[ahead])
        cycle = np.arange(n)
        on = np.unique(ahead)
        on = on[on < n]
        log.append((on, low[on], at, parent < n, out_of, in_to))
        if not len(on):
            break
        cycle[on] = low[on]
        gone = np.zeros(n)
        gone[on] = cost[on]
        weight = weight - gone[dst]
        src, dst, at = cycle[src], cycle[dst], cycle[at]
        affinity = affinity - gone
        root = _last(affinity, -into, of=(cycle,))
        affinity[cycle[root]], into[cycle[root]] = affinity[root], into[root]
        stay = np.flatnonzero((src != dst) & (weight > affinity[dst]))
        stay = stay[_last(weight[stay], -out[stay], -land[stay], of=(dst[stay], src[stay]))]
        src, dst, weight, out, land = src[stay], dst[stay], weight[stay], out[stay], land[stay]
    _, _, _, takes, out_of, in_to = log.pop()
    for on, low, was, took, own_out, own_in in reversed(log):
        # a cycle's arc replaces that of the node where it lands; the others keep theirs
        heads = np.unique(low)
        landed = was[np.searchsorted(given, in_to[heads])]
        new = takes[heads], out_of[heads], in_to[heads]
        takes[on], out_of[on], in_to[on] = took[on], own_out[on], own_in[on]
        takes[landed], out_of[landed], in_to[landed] = new
    return takes, out_of, in_to


def _spanned(node: np.ndarray, affinity: np.ndarray, into: np.ndarray, edges: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_rounds`, of edges that weigh the same in either direction: the heaviest spanning tree of the nodes and of a place that all roots hang on."""
    n = len(node)
    a, b = (np.append(np.searchsorted(node, edges[0]), np.arange(n)), np.append(np.searchsorted(node, edges[1]), np.full(n, n)))
    worth, src, dst = (np.append(x, y) for x, y in zip(edges[2:], (affinity, into, into), strict=True))
    order = np.lexsort((dst, src, np.arange(len(worth)) < len(worth) - n, -worth))
    part, around = list(range(n + 1)), [[] for _ in range(n + 1)]

    def top(x: int) -> int:
        while part[x] != x:
            part[x] = x = part[part[x]]
        return x

    for e, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        s, t = top(x), top(y)
        if s != t:
            part[s] = t
            around[x].append((y, e, False))
            around[y].append((x, e, True))
    takes, out_of, in_to = np.zeros(n + 1, bool), np.zeros(n + 1, np.int64), np.append(into, 0)
    ways = [(n, -1)]
    while ways:
        x, came = ways.pop()
        for y, e, forth in around[x]:  # an edge's second end is y's own where it leads forth, from b to a
            if e != came:
                ways.append((y, e))
                if x != n:
                    takes[y], out_of[y], in_to[y] = True, dst[e] if forth else src[e], src[e] if forth else dst[e]
    return takes[:n], out_of[:n], in_to[:n]


def _in_tasks(graph: DataFrame, alone: DataFrame, solved=_rounds) -> DataFrame:
    """``node``, ``from``, ``into``: what each node takes; components of `graph` are dealt to tasks."""
    roots = components(graph.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    deal = F.pmod(F.xxhash64(F.coalesce("root", "node")), F.lit(2 * graph.sparkSession.sparkContext.defaultParallelism)).cast("int").alias("deal")
    dealt = cut_lineage(alone.select("node").join(roots, "node", "left").select("node", deal))
    arcs = graph.join(dealt.withColumnRenamed("node", "dst"), "dst").select(F.col("deal").alias("part"), "src", "dst", "weight", "from", "into")

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by("node")
        node, affinity, into = (a[c].to_numpy() for c in ("node", "affinity", "into"))
        takes, out, land = solved(node, affinity, into, tuple(b[c].to_numpy() for c in ("src", "dst", "weight", "from", "into")))
        return pa.table({"node": node, "from": pa.array(out, pa.int64(), mask=~takes), "into": land})

    found = alone.join(dealt, "node").groupBy("deal").cogroup(arcs.groupBy("part")).applyInArrow(solve, "node long, from long, into long")
    chosen = cut_lineage(found)
    drop(roots, dealt)
    return chosen


def _worth(arcs: DataFrame, alone: DataFrame) -> DataFrame:
    """The arcs that are worth more than what their end is worth as a root: no other one is ever taken."""
    return arcs.join(alone.select(F.col("node").alias("dst"), "affinity"), "dst").filter("weight > affinity").drop("affinity")


def _even(given: DataFrame) -> bool:
    """Whether each arc has one back that weighs as much."""
    pairs = given.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).agg(F.count("weight").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    return pairs.filter((F.col("n") != 2) | (F.col("low") != F.col("high")) | F.isnan("high")).isEmpty()


def _forest(given: DataFrame, names: DataFrame) -> DataFrame:
    """``node``, ``from``, ``into``: what each node takes of arcs that weigh the same in either direction.

    A part of the forest takes its best edge, or its best root where no edge is worth more; then its affinity counts as
    infinite, and others may join it, but it takes no more. Ties go to the root, then to the smaller ends. Parts that hang
    together by what they took become one. Going back, the way from where a part is entered up to its top is turned round.
    """

    def _worthy(edges: DataFrame, alone: DataFrame) -> DataFrame:
        own = alone.select("node", "affinity")
        return edges.join(own.toDF("a", "_a"), "a").join(own.toDF("b", "_b"), "b").filter(F.col("weight") > F.least("_a", "_b")).select("a", "b", "weight", "src", "dst")

    alone = cut_lineage(names.select("node", "affinity", F.col("node").alias("into")))
    at = cut_lineage(names.select("node", F.col("node").alias("at")))
    graph = cut_lineage(_worthy(given.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "src", "dst"), alone))
    log: list[tuple[DataFrame, DataFrame]] = []
    while graph.count() > FEW:
        cost = (-F.col("weight")).alias("cost")
        ends = (F.struct(cost, "src", "dst", F.col(x).alias("node"), F.col(y).alias("parent"), F.col(s).alias("into"), F.col(t).alias("from")) for x, y, s, t in (("a", "b", "src", "dst"), ("b", "a", "dst", "src")))
        best = graph.select(F.explode(F.array(*ends)).alias("e")).groupBy("e.node").agg(F.min("e").alias("e"))
        takes = -F.col("e.cost") > F.col("affinity")
        picks = alone.withColumnRenamed("into", "home").join(best, "node", "left").select("node", "affinity", "home", *(F.when(takes, F.col(f"e.{c}")).alias(c) for c in ("parent", "from", "into")))
        picks = cut_lineage(picks)
        # of two parts that took the same edge the smaller one is the top
        back = picks.select(F.col("node").alias("parent"), F.col("parent").alias("_back"))
        top = F.col("parent").isNull() | (F.col("_back").eqNullSafe(F.col("node")) & (F.col("node") < F.col("parent")))
        worth = F.when(F.col("parent").isNull(), float("inf")).otherwise(F.col("affinity")).alias("worth")
        ups = cut_lineage(picks.join(back, "parent", "left").select("node", worth, "home", "from", "into", F.when(~top, F.col("parent")).alias("parent")))
        found = _roots(ups.select("node", "parent"))
        part = found.select("node", "root")
        grown = ups.join(part, "node").groupBy("root").agg(F.max(F.struct("worth", (-F.col("home")).alias("_h"), "home")).alias("b"))
        next_alone = cut_lineage(grown.select(F.col("root").alias("node"), F.col("b.worth").alias("affinity"), F.col("b.home").alias("into")))
        joined = graph.join(part.toDF("a", "_a"), "a").join(part.toDF("b", "_b"), "b").filter("_a <> _b")
        few = joined.groupBy(F.least("_a", "_b"), F.greatest("_a", "_b")).agg(F.min(F.struct(cost, "src", "dst", F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("e"))
        next_graph = cut_lineage(_worthy(few.select("e.a", "e.b", (-F.col("e.cost")).alias("weight"), "e.src", "e.dst"), next_alone))
        next_at = cut_lineage(at.join(part.toDF("at", "root"), "at").select("node", F.col("root").alias("at")))
        log.append((ups, at))
        drop(graph, alone, picks, found)
        graph, alone, at = next_graph, next_alone, next_at
    chosen = _in_tasks(graph.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", F.col("src").alias("from"), F.col("dst").alias("into")), alone, _spanned)
    drop(graph, alone, at)
    for ups, at in reversed(log):
        entered = cut_lineage(chosen.select("from", "into").join(at.toDF("into", "node"), "into").select("node", "from", "into"))
        ahead = cut_lineage(ups.filter("parent IS NOT NULL").select("node", "parent"))
        way = cut_lineage(entered.select("node"))
        while not (more := cut_lineage(way.join(ahead, "node").select(F.col("parent").alias("node")))).isEmpty():
            longer = cut_lineage(way.unionByName(more))
            doubled = cut_lineage(ahead.join(ahead.toDF("parent", "_to"), "parent").select("node", F.col("_to").alias("parent")))
            drop(way, more, ahead)
            way, ahead = longer, doubled
        turned = ups.join(way, "node").filter("parent IS NOT NULL").select(F.col("parent").alias("node"), F.col("into").alias("from"), F.col("from").alias("into"))
        kept = ups.join(way, "node", "left_anti").select("node", "from", "into")
        opened = cut_lineage(entered.unionByName(turned).unionByName(kept))
        drop(chosen, ups, at, entered, ahead, way, more)
        chosen = opened
    return chosen


def _contracted(given: DataFrame, names: DataFrame) -> DataFrame:
    """``node``, ``from``, ``into``: what each node takes, by contracting cycles."""
    # arcs and affinities of this level; `from` and `into` are the ends that the arc has among the given nodes
    graph = cut_lineage(_worth(given.select("src", "dst", "weight", F.col("src").alias("from"), F.col("dst").alias("into")), names))
    alone = cut_lineage(names.select("node", "affinity", F.col("node").alias("into")))
    at = cut_lineage(names.select("node", F.col("node").alias("at")))
    log: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    while True:
        if graph.count() <= FEW:
            chosen = _in_tasks(graph, alone)
            drop(graph, alone, at)
            break
        order = F.struct("weight", (-F.col("src")).alias("_s"), "from", "into", "src")
        best = graph.groupBy(F.col("dst").alias("node")).agg(F.max(order).alias("b"))
        takes = F.col("b.weight") > F.col("affinity")
        picks = alone.join(best, "node", "left").select(
            "node", F.when(takes, F.col("b.src")).alias("parent"), F.when(takes, F.col("b.from")).alias("from"),
            F.when(takes, F.col("b.into")).otherwise(F.col("into")).alias("into"), F.when(takes, F.col("b.weight")).alias("weight"),
        )
        picks = cut_lineage(picks)
        cycles = _cycles(picks)
        if cycles.isEmpty():
            chosen = cut_lineage(picks.select("node", "from", "into"))
            drop(graph, alone, at, picks, cycles)
            break
        cost = cycles.join(picks.select("node", F.col("weight").alias("cost")), "node")
        target = cost.select(F.col("node").alias("dst"), F.col("cycle").alias("_d"), "cost")
        moved = graph.join(target, "dst", "left").join(cycles.toDF("src", "_s"), "src", "left")
        moved = moved.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), (F.col("weight") - F.coalesce("cost", F.lit(0.0))).alias("weight"), "from", "into").filter("src <> dst")
        keep = F.max(F.struct("weight", (-F.col("from")).alias("_f"), (-F.col("into")).alias("_i"), "from", "into"))
        shrunk = alone.join(cost, "node", "left").select(F.coalesce("cycle", "node").alias("node"), (F.col("affinity") - F.coalesce("cost", F.lit(0.0))).alias("affinity"), "into")
        next_alone = cut_lineage(shrunk.groupBy("node").agg(F.max(F.struct("affinity", (-F.col("into")).alias("_i"), "into")).alias("b")).select("node", "b.affinity", "b.into"))
        merged = moved.groupBy("src", "dst").agg(keep.alias("b")).select("src", "dst", "b.weight", "b.from", "b.into")
        next_graph = cut_lineage(_worth(merged, next_alone))
        # of the given nodes in cycles, where they were at this level: where an arc into the cycle has landed
        landed = cut_lineage(at.join(cycles.withColumnRenamed("node", "at"), "at").select(F.col("node").alias("into"), "at", "cycle"))
        next_at = cut_lineage(at.join(cycles.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("cycle", "at").alias("at")))
        drop(graph, alone, at)
        log.append((picks, cycles, landed))
        graph, alone, at = next_graph, next_alone, next_at
    for picks, cycles, landed in reversed(log):
        into_cycles = chosen.join(landed, (chosen["node"] == landed["cycle"]) & (chosen["into"] == landed["into"]))
        broken = into_cycles.select(landed["at"].alias("node"), chosen["from"], chosen["into"])
        kept = picks.join(cycles.select("node"), "node", "left_semi").join(broken.select("node"), "node", "left_anti").select("node", "from", "into")
        outside = chosen.join(cycles.select(F.col("cycle").alias("node")).distinct(), "node", "left_anti")
        opened = cut_lineage(outside.unionByName(broken).unionByName(kept))
        drop(chosen, picks, cycles, landed)
        chosen = opened
    return chosen


def max_branching(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``parent``, ``weight``, ``root``, ``tree``: the branching with the largest sum of arc weights and of its roots' affinities.

    `arcs` has ``src``, ``dst``, ``weight``; `nodes` has ``node`` and ``affinity``, what it is worth to leave the node a
    root. ``parent`` and ``weight`` are null at a root. Trees are numbered from 0 in the order of their roots. Ties go
    to the root, then to the smaller ``src`` (to the smaller ends, where all arcs weigh the same in either direction). Loops
    and arcs of other nodes are left out; of several arcs between the same nodes the heaviest counts.
    """
    names = cut_lineage(nodes.groupBy("node").agg(F.max(F.col("affinity").cast("double")).alias("affinity")))
    known = names.select("node")
    given = arcs.filter("src <> dst").groupBy("src", "dst").agg(F.max(F.col("weight").cast("double")).alias("weight"))
    given = cut_lineage(given.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi"))
    chosen = _forest(given, names) if _even(given) else _contracted(given, names)
    parents = chosen.select("node", F.col("from").alias("parent"))
    parents = cut_lineage(parents.join(given.select(F.col("dst").alias("node"), F.col("src").alias("parent"), "weight"), ["node", "parent"], "left"))
    roots = _roots(parents)
    trees = numbered(roots.filter("node = root").select("root"), F.col("root"), "tree")
    out = cut_lineage(parents.join(roots, "node").join(trees, "root").select("node", "parent", "weight", "root", "tree"))
    drop(names, given, chosen, parents, roots)
    return out


def _roots(parents: DataFrame) -> DataFrame:
    """``node``, ``root`` of a forest's ``node``, ``parent``, by doubling."""
    up = cut_lineage(parents.select("node", F.coalesce("parent", "node").alias("root")))
    while True:
        far = up.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        new = cut_lineage(up.join(far, "root").select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")))
        still = new.filter("moved").isEmpty()
        drop(up)
        up = new
        if still:
            return up
