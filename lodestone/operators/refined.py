"""Communities that are refined before they are contracted, so that each of them holds together.

A level has three steps, each of them joins and groupings over the edges: nodes move to the community that gains most;
inside each community a second, finer partition is grown from single nodes, which merge along well-connected links
only; then the finer groups become the nodes of the next level, which starts from the communities of this one. So what
moves at the next level are parts that hold together, and a community may be split as well as joined.

Weights are counted in whole units, so that sums don't depend on their order, and draws are keyed by node and
round: labels are the same for any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import components, cut_lineage, drop
from .edges import both_ways, degrees
from .sampling import uniform

#: The largest weight in units.
UNITS = 1 << 30


def _moved(graph: DataFrame, masses: DataFrame, labels: DataFrame, price: float, unit: float, rounds: int, seed: int) -> DataFrame:
    """`labels` (``node``, ``label``) after up to `rounds` rounds in which half of the nodes may move, to a neighbour's label or to one of their own.

    Of two rounds a node has its turn in one; if nothing moves in both, no node gains by moving.
    """
    around = cut_lineage(both_ways(graph))
    start, quiet = labels, 0
    for r in range(rounds):
        at = masses.join(labels.select("node", "label"), "node")
        mass = at.groupBy("label").agg(F.sum("k").alias("mass"))
        toward = around.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").groupBy("src", "to").agg(F.sum("units").alias("units"))
        own = at.join(mass, "label").select(F.col("node").alias("src"), "k", "label", F.col("mass").alias("mine"))
        scored = toward.join(own, "src").join(mass.toDF("to", "mass"), "to")
        here = F.col("to") == F.col("label")
        gain = F.col("units") * unit - F.col("k") * (F.col("mass") - F.when(here, F.col("k")).otherwise(0)) * price
        best = scored.groupBy("src").agg(
            F.max(F.struct(gain.alias("g"), "to")).alias("best"), F.max(F.when(here, gain)).alias("stay"),
            F.max(-F.col("k") * (F.col("mine") - F.col("k")) * price).alias("unlinked"),
        )
        stays, leaves = F.coalesce("stay", "unlinked"), F.col("best.g") < 0
        to = F.when(leaves, F.struct(F.col("src").alias("node"), F.lit(seed + r + 1).alias("round"))).otherwise(F.col("best.to"))
        turn = (uniform(seed, F.lit(r // 2), "src") < 0.5) == F.lit(r % 2 == 0)
        moves = best.filter((F.greatest("best.g", F.lit(0.0)) > stays + 1e-9) & turn).select(F.col("src").alias("node"), to.alias("to"))
        new = cut_lineage(labels.select("node", "label").join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")))
        quiet = quiet + 1 if new.filter("moved").isEmpty() else 0
        drop(*([labels] if labels is not start else []))
        labels = new
        if quiet >= 2 and r % 2 == 1:
            break
    drop(around)
    return labels


def _refined(graph: DataFrame, masses: DataFrame, labels: DataFrame, price: float, unit: float, rounds: int, theta: float, seed: int) -> DataFrame:
    """``node``, ``ref``: groups inside the communities of `labels`, grown from single nodes; each is connected.

    In each round half of the groups stay; of the others those of a single node that are well connected to the rest of
    their community may join a well-connected group, drawn by exp(gain / `theta`) among those with a gain. Of several
    that would join one group, the best does, and the others do if they still gain with all of them there.
    """
    inside = graph.join(labels.toDF("src", "_a"), "src").join(labels.toDF("dst", "_b"), "dst").filter("_a = _b").select("src", "dst", "units")
    around = cut_lineage(both_ways(inside))
    whole = masses.join(labels, "node").groupBy("label").agg(F.sum("k").alias("whole"))
    held = cut_lineage(masses.join(labels, "node").join(whole, "label").select("node", "k", "whole"))
    ref, quiet = cut_lineage(held.select("node", F.col("node").alias("ref"), F.lit(False).alias("moved"))), 0
    for r in range(rounds):
        of = ref.select("node", "ref")
        linked = around.join(of.toDF("src", "own"), "src").join(of.toDF("dst", "to"), "dst").filter("own <> to").groupBy("own", "to").agg(F.sum("units").alias("units"))
        groups = held.join(of, "node").groupBy("ref").agg(F.sum("k").alias("k"), F.count("*").alias("size"), F.max("whole").alias("whole"))
        out = linked.groupBy("own").agg(F.sum("units").alias("out")).withColumnRenamed("own", "ref")
        well = F.col("out") * unit >= price * F.col("k") * (F.col("whole") - F.col("k"))
        stays = uniform(seed, F.lit(r), "ref") < 0.5
        groups = groups.join(out, "ref").filter(well).select("ref", "k", "size", stays.alias("stays"))
        movers = groups.filter("size = 1 AND NOT stays").select(F.col("ref").alias("own"), F.col("k").alias("mine"))
        targets = groups.filter("size > 1 OR stays").select(F.col("ref").alias("to"), F.col("k").alias("theirs"))
        gain = F.col("units") * unit - price * F.col("mine") * F.col("theirs")
        open_ = linked.join(movers, "own").join(targets, "to").withColumn("gain", gain).filter("gain >= 0")
        draw = F.col("gain") / theta - F.log(-F.log(uniform(seed + 1, F.lit(r), "own", "to")))
        picked = open_.groupBy("own").agg(F.max(F.struct(draw.alias("draw"), "to", "gain", "mine")).alias("p")).select("own", "p.to", "p.gain", "p.mine")
        come = picked.groupBy("to").agg(F.sum("mine").alias("come"), F.max(F.struct("gain", "own")).alias("first"))
        fits = (F.col("own") == F.col("first.own")) | (F.col("gain") - price * F.col("mine") * (F.col("come") - F.col("mine")) > 0)
        joins = picked.join(come, "to").filter(fits).select(F.col("own").alias("ref"), "to")
        new = cut_lineage(of.join(joins, "ref", "left").select("node", F.coalesce("to", "ref").alias("ref"), F.col("to").isNotNull().alias("moved")))
        quiet = quiet + 1 if new.filter("moved").isEmpty() else 0
        drop(ref)
        ref = new
        if quiet == 2:
            break
    drop(around, held)
    return ref


def _one_pass(graph: DataFrame, masses: DataFrame, members: DataFrame, price: float, unit: float, rounds: int, levels: int, theta: float, seed: int) -> DataFrame:
    """``node``, ``label`` after one way from the nodes up; `members` has the labels to start from.

    At the end the nodes move by themselves once more: a node that lower levels left in the wrong group went with it.
    """
    nodes_graph, nodes_masses = graph, masses
    at = cut_lineage(masses.select("node", F.col("node").alias("at")))  # of each node, its node at the level
    first = lambda c: F.struct(F.col(c).alias("node"), F.lit(0).alias("round"))
    labels = cut_lineage(members.select("node", first("label").alias("label")))
    owned: list[DataFrame] = []
    for level in range(levels):
        moved = _moved(graph, masses, labels, price, unit, rounds, seed + 1000 * level)
        final = moved.select("node", "label")
        ref = _refined(graph, masses, final, price, unit, rounds, theta, seed + 1000 * level + 500)
        of = ref.select("node", "ref")
        before, after = masses.count(), ref.select("ref").distinct().count()
        if before == after or level + 1 == levels:
            found = cut_lineage(at.join(final.toDF("at", "_l"), "at").select("node", F.col("_l").alias("label")))
            drop(moved, ref, at, *([labels] if moved is not labels else []), *owned)
            last = _moved(nodes_graph, nodes_masses, found, price, unit, rounds, seed + 1000 * levels)
            out = cut_lineage(last.select("node", "label"))
            drop(last, *([found] if last is not found else []))
            return out
        placed = final.join(of, "node")
        names = placed.groupBy("label").agg(F.min("ref").alias("name"))
        next_labels = cut_lineage(placed.join(names, "label").groupBy(F.col("ref").alias("node")).agg(F.min("name").alias("name")).select("node", first("name").alias("label")))
        next_masses = cut_lineage(masses.join(of, "node").groupBy("ref").agg(F.sum("k").alias("k")).toDF("node", "k"))
        ends = graph.join(of.toDF("src", "_a"), "src").join(of.toDF("dst", "_b"), "dst").filter("_a <> _b")
        next_graph = cut_lineage(ends.groupBy(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).agg(F.sum("units").alias("units")))
        next_at = cut_lineage(at.join(of.toDF("at", "_to"), "at").select("node", F.col("_to").alias("at")))
        drop(at, moved, ref, *([labels] if moved is not labels else []), *owned)
        graph, masses, labels, at, owned = next_graph, next_masses, next_labels, next_at, [next_graph, next_masses]
    raise AssertionError("levels must be at least 1")


def connected_parts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``node``, ``label``: each label's parts that are linked by `edges` within it, named by their least node."""
    inside = edges.join(labels.toDF("src", "_a"), "src").join(labels.toDF("dst", "_b"), "dst").filter("_a = _b")
    roots = components(inside.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    out = cut_lineage(labels.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")))
    drop(roots)
    return out


def refined_communities(
    edges: DataFrame, nodes: DataFrame, *, resolution: float = 1.0, objective: str = "cpm", passes: int = 2, rounds: int = 6, levels: int = 10, theta: float = 0.01,
    node_weight: str | Column | None = None, start: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """``node``, ``label``: communities of high quality, each connected and named by its least node.

    `edges` has ``src``, ``dst`` and ``weight`` above 0, `nodes` ``node``. A community of mass K and inner weight w is
    worth w − `resolution`·K²/2, where K counts nodes, or `node_weight`; with `objective` "modularity" K is the sum of
    degrees and the resolution is divided by twice the total weight. `passes` ways from the nodes up are made, each from
    the labels of the last (the first from `start`, or from single nodes), until one changes nothing. `theta` is the
    randomness of refinement, in units of weight. Loops, and edges of other nodes, are left out; a node without edges
    is alone.
    """
    if objective not in ("modularity", "cpm"):
        raise ValueError(f"no such objective: {objective}")
    names = nodes.select("node").distinct()
    given = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    given = cut_lineage(given.join(names.toDF("src"), "src", "left_semi").join(names.toDF("dst"), "dst", "left_semi"))
    labels = cut_lineage(start.select("node", "label") if start is not None else names.select("node", F.col("node").alias("label")))
    most = given.agg(F.max("weight")).first()[0]
    if not most:
        out = cut_lineage(names.select("node", F.col("node").alias("label")))
        drop(given, labels)
        return out
    unit = most / UNITS
    graph = cut_lineage(given.select("src", "dst", F.round(F.col("weight") / unit).cast("long").alias("units")).filter("units > 0"))
    price = resolution
    if objective == "modularity":
        found = degrees(graph, "units").select("node", (F.col("degree") * unit).alias("k"))
        masses = names.join(found, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"))
        price = resolution / (2 * unit * graph.agg(F.sum("units")).first()[0])
    elif node_weight is not None:
        masses = nodes.groupBy("node").agg(F.sum(node_weight).cast("double").alias("k"))
    else:
        masses = names.withColumn("k", F.lit(1.0))
    masses = cut_lineage(masses)
    for p in range(passes):
        found = _one_pass(graph, masses, labels, price, unit, rounds, levels, theta, seed + 100_000 * p)
        parts = connected_parts(graph, found)
        changed = not parts.join(labels, ["node", "label"], "left_anti").isEmpty()
        drop(found, labels)
        labels = parts
        if not changed:
            break
    drop(given, graph, masses)
    return labels


def tuned(edges: DataFrame, nodes: DataFrame, groups: int, *, resolution: float = 1.0, tries: int = 20, slack: int = 0, **options) -> DataFrame:
    """`refined_communities` of the resolution whose number of communities comes nearest to `groups`.

    Resolutions between 1e-6 and 10 are halved by their logarithms, until a number is within `slack`; each try starts
    from the labels of the last, so it takes a pass or two.
    """
    low, high = 1e-6, 10.0
    best, off, last = None, None, None
    for _ in range(tries):
        last = refined_communities(edges, nodes, resolution=resolution, start=last, **options)
        n = last.select("label").distinct().count()
        if off is None or abs(n - groups) < off:
            best, off = last, abs(n - groups)
        low, high = (low, resolution) if n > groups else (resolution, high)
        if off <= slack or high < low * 1.0001:
            break
        resolution = (low * high) ** 0.5
    return best
