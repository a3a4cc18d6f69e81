"""What is found by going over a graph again and again: components, depths, cores, ranks, communities.

Each round is a join and a grouping. Lineage is cut in the shared checkpoint folder, so that a lost executor
costs no recomputation of earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import components, cut_lineage, drop, numbered, with_totals
from .edges import both_ways, contract, degrees

#: Residuals are added up in whole numbers of 1 / UNIT, so that the order of addition doesn't tell in their last digits.
UNIT = 2.0**58
#: Fixed value: two groups are paired at a common neighbour if the weaker of their links to it is at least this share of the stronger.
PAIRED = 0.5


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``component``: components numbered from 0 in the order of their least node; `nodes` has ``node``."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    rooted = cut_lineage(nodes.select("node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return rooted.join(numbered(rooted.select("root").distinct(), F.col("root"), "component"), "root").select("node", "component")


def depths(edges: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """``node``, ``depth``, ``parent`` by breadth from `start`; the parent is the least node of the layer before."""
    around = both_ways(edges.select("src", "dst"))
    spark = edges.sparkSession
    reached = spark.createDataFrame([(start, 0, None)], "node long, depth int, parent long")
    layer, depth = reached, 0
    while most is None or depth < most:
        depth += 1
        new = layer.select(F.col("node").alias("src")).join(around, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        layer = cut_lineage(new.join(reached.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if layer.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(layer))
    return reached


def far_end(edges: DataFrame, start: int) -> DataFrame:
    """``node``, ``depth``: the least of the nodes that lie farthest from `start`; one row."""
    return depths(edges, start).agg(F.min(F.struct(-F.col("depth"), "node")).alias("far")).select("far.node", (-F.col("far.col1")).alias("depth"))


def core(edges: DataFrame, k: int) -> DataFrame:
    """The edges of the `k`-core: nodes of a lower degree go until none is left."""
    edges = cut_lineage(edges.select("src", "dst"))
    n = edges.count()
    while True:
        stay = degrees(edges).filter(F.col("degree") >= k).select("node")
        edges = cut_lineage(edges.join(stay.toDF("src"), "src", "left_semi").join(stay.toDF("dst"), "dst", "left_semi"))
        m = edges.count()
        if m == n:
            return edges
        n = m


def personal_ranks(edges: DataFrame, top: int, *, restart: float = 0.15, least: float = 1e-4, sources: DataFrame | None = None) -> DataFrame:
    """``source``, ``rank``, ``node``, ``score``: the `top` nodes by personalised PageRank from each source.

    Residuals above `least` times the degree are pushed on, all of them in each round. A source has at most
    1 / (least · restart) of them, however large the graph. Scores that agree to 12 places are ties; the smaller node comes first.
    Sums don't depend on the order of rows: nodes that lie alike have the same score to the last digit, in each run.
    """
    around = both_ways(edges.select("src", "dst"))
    d = degrees(edges).withColumnRenamed("degree", "d")
    start = d.select(F.col("node").alias("source")) if sources is None else sources
    rest = cut_lineage(start.select("source", F.col("source").alias("node"), F.lit(1.0).alias("r")).join(d.select("node"), "node", "left_semi"))
    score = last = None
    while True:
        sized = rest.join(d, "node")
        pushed = sized.filter(F.col("r") >= least * F.col("d"))
        if pushed.isEmpty():
            break
        gained = pushed.select("source", "node", (restart * F.col("r")).alias("s"))
        score = gained if score is None else score.unionByName(gained)
        grown = cut_lineage(score.groupBy("source", "node").agg(F.sum("s").alias("s")))  # at most two rows a node
        spread = pushed.join(around.toDF("node", "to"), "node").select("source", F.col("to").alias("node"), ((1 - restart) * F.col("r") / F.col("d")).alias("r"))
        stay = sized.filter(F.col("r") < least * F.col("d")).select("source", "node", "r")
        units = F.sum(F.rint(F.col("r") * UNIT).cast("long"))
        left = cut_lineage(stay.unionByName(spread).groupBy("source", "node").agg((units / UNIT).alias("r")))
        drop(rest, *([] if last is None else [last]))
        score, last, rest = grown, grown, left
    drop(rest)
    if score is None:
        return start.sparkSession.createDataFrame([], "source long, rank int, node long, score double")
    # scores that are the same but for rounding are ties, and go by node
    place = W.partitionBy("source").orderBy(F.round("s", 12).desc(), "node")
    ranked = score.filter("node <> source").withColumn("rank", F.row_number().over(place))
    return ranked.filter(F.col("rank") <= top).select("source", "rank", "node", F.col("s").alias("score"))


def communities(edges: DataFrame, nodes: DataFrame, *, resolution: float = 1.0, rounds: int = 20, levels: int = 5, objective: str = "modularity") -> DataFrame:
    """``node``, ``label``: communities of high modularity, by moving nodes in parallel and contracting.

    In each round half of the nodes (by a hash of node and round) may move to the neighbouring community with
    the largest gain, weight to it − k·K·resolution / 2W; then the communities become nodes. All is joins and
    groupings; `nodes` has ``node``, `edges` a ``weight``. With `objective` "cpm", the constant Potts model, k and K
    are numbers of nodes and the gain is the weight − k·K·resolution.
    """
    if objective not in ("modularity", "cpm"):
        raise ValueError(f"no such objective: {objective}")
    graph = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    total = graph.agg(F.sum("weight")).first()[0]
    members = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    if not total:
        return members
    masses, price = degrees(graph, "weight").toDF("node", "k"), resolution / (2 * total)
    if objective == "cpm":
        masses, price = masses.withColumn("k", F.lit(1.0)), resolution
    masses = cut_lineage(masses)
    for level in range(levels):
        labels = cut_lineage(masses.select("node", F.col("node").alias("label")))
        around = cut_lineage(both_ways(graph).filter("src <> dst"))
        for r in range(rounds):
            mass = masses.join(labels, "node").groupBy("label").agg(F.sum("k").alias("mass"))
            toward = around.join(labels.toDF("dst", "to"), "dst").groupBy("src", "to").agg(F.sum("weight").alias("w"))
            own = masses.join(labels, "node").join(mass, "label").select(F.col("node").alias("src"), "k", "label", F.col("mass").alias("mine"))
            scored = toward.join(own, "src").join(mass.toDF("to", "mass"), "to")
            rest = F.when(F.col("to") == F.col("label"), F.col("mass") - F.col("k")).otherwise(F.col("mass"))
            gain = F.col("w") - F.col("k") * rest * price
            best = scored.groupBy("src").agg(F.max(F.struct(gain.alias("g"), (-F.col("to")).alias("t"))).alias("best"), F.max(F.when(F.col("to") == F.col("label"), gain)).alias("stay"), F.first(-F.col("k") * (F.col("mine") - F.col("k")) * price).alias("alone"))
            moves = best.filter((F.col("best.g") > F.coalesce("stay", "alone") + 1e-12) & (F.pmod(F.xxhash64("src", F.lit(r), F.lit(level)), F.lit(2)) == 0)).select(F.col("src").alias("node"), (-F.col("best.t")).alias("to"))
            moves = cut_lineage(moves)
            if moves.isEmpty() and r > 1:
                break
            labels = cut_lineage(labels.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label")))
        members = cut_lineage(members.toDF("node", "_at").join(labels.toDF("_at", "_to"), "_at", "left").select("node", F.coalesce("_to", "_at").alias("label")))
        moved = labels.filter("node <> label").limit(1).count()
        if not moved:
            break
        a, b = labels.toDF("src", "_a"), labels.toDF("dst", "_b")
        joined = graph.join(a, "src").join(b, "dst").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "weight")
        masses = cut_lineage(masses.join(labels, "node").groupBy("label").agg(F.sum("k").alias("k")).toDF("node", "k"))
        graph = cut_lineage(joined.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    return members


def tuned_communities(edges: DataFrame, nodes: DataFrame, groups: int, *, resolution: float = 1.0, tries: int = 20, objective: str = "cpm", **options) -> DataFrame:
    """``node``, ``label``: of communities at up to `tries` resolutions, those whose number comes nearest to `groups`.

    Resolutions between 1e-6 and 10 are halved by their logarithms, from `resolution` on; nodes without edges count.
    """
    low, high = 1e-6, 10.0
    best, off = None, None
    for _ in range(tries):
        labels = communities(edges, nodes, resolution=resolution, objective=objective, **options)
        n = labels.select("label").distinct().count()
        if off is None or abs(n - groups) < off:
            best, off = labels, abs(n - groups)
        low, high = (low, resolution) if n > groups else (resolution, high)
        if off == 0 or high < low * 1.0001:
            break
        resolution = (low * high) ** 0.5
    return best


def _merges(graph: DataFrame, sizes: DataFrame, draw: int) -> DataFrame:
    """``direct``, ``link``, ``a`` < ``b``: the groups that merge in a round of `coarsened`, each in one row at most."""
    sized = graph.join(sizes.toDF("src", "_m"), "src").join(sizes.toDF("dst", "_n"), "dst")
    edge = F.struct((F.col("weight") / (F.col("_m") * F.col("_n"))).alias("link"), F.xxhash64("src", "dst", F.lit(draw)).alias("tie"), "src", "dst")
    ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("src", "dst"), ("dst", "src"))))
    picks = sized.withColumn("e", edge).select("e", F.explode(ends).alias("end")).groupBy("end.node").agg(F.max(F.struct("e", "end.other")).alias("pick"))
    picks = cut_lineage(picks.select("node", "pick.other", "pick.e"))
    mutual = picks.groupBy("e").agg(F.count("*").alias("picked")).filter("picked = 2").select(F.lit(True).alias("direct"), "e.link", F.col("e.src").alias("a"), F.col("e.dst").alias("b"))
    mutual = cut_lineage(mutual)
    taken = mutual.select(F.explode(F.array("a", "b")).alias("node"))
    waiting = picks.join(taken, "node", "left_anti").join(taken.toDF("other"), "other").select("node", "other", "e.link")
    # those that wait at a hub are dealt to parts of about a thousand, and paired by link within
    dealt = with_totals(waiting, ["other"], n=F.count("*")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(draw)), F.ceil(F.col("n") / 1000)))
    place = F.row_number().over(W.partitionBy("other", "part").orderBy(F.desc("link"), "node"))
    pairs = dealt.withColumn("slot", F.floor((place - 1) / 2)).groupBy("other", "part", "slot").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min("link").alias("link"), F.max("link").alias("top"))
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.col("link") >= PAIRED * F.col("top"))).select(F.lit(False).alias("direct"), "link", "a", "b")
    out = cut_lineage(mutual.unionByName(pairs))
    drop(picks, mutual)
    return out


def coarsened(edges: DataFrame, nodes: DataFrame, target: int, *, seed: int = 42) -> DataFrame:
    """``node``, ``label``: a partition of `nodes` into about `target` groups, each named by its least node.

    A round is three joins over the edges and two groupings. The first grouping finds every group's best edge, by
    ``weight`` over the product of both sizes; edges that are the best of both their ends are merges. The second deals
    the groups whose best neighbour merges with another one to that neighbour, in parts of about a thousand, and merges
    them two by two there, in the order of their links (`PAIRED`). Then merged groups are contracted. If a round has
    more merges than are needed, the first ones in the order of kind and link are taken. It ends above `target` when no
    group has a neighbour left. Nodes without edges keep a group of their own, edges of nodes that aren't in `nodes`
    don't count, and equal links are ordered by a hash of `seed`.
    """
    members = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    sizes = cut_lineage(nodes.select("node", F.lit(1).cast("long").alias("size")))
    graph = cut_lineage(contract(edges, members))
    count, draw = members.count(), seed
    while count > target:
        merges, draw = _merges(graph, sizes, draw), draw + 1
        n = merges.count()
        if n == 0:
            break
        chosen = merges
        if n > count - target:
            order = F.struct(~F.col("direct"), -F.col("link"), F.col("a"))
            chosen, n = numbered(merges, order, "no").filter(F.col("no") < count - target), count - target
        labels = cut_lineage(sizes.join(chosen.select(F.col("b").alias("node"), F.col("a").alias("to")), "node", "left").select("node", "size", F.coalesce("to", "node").alias("label")))
        to = labels.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        old = members, sizes, graph, merges, labels
        members = cut_lineage(members.toDF("node", "_at").join(to, "_at").select("node", F.col("_to").alias("label")))
        sizes = cut_lineage(labels.groupBy("label").agg(F.sum("size").alias("size")).toDF("node", "size"))
        graph = cut_lineage(contract(graph, labels.select("node", "label")))
        drop(*old)
        count -= n
    return members


def spanning_tree(edges: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight``: a minimum spanning forest, by each part's lightest edge to another, round by round."""
    graph = cut_lineage(edges.select("src", "dst", "weight"))
    part = cut_lineage(both_ways(graph).select(F.col("src").alias("node"), F.col("src").alias("part")).distinct())
    tree = None
    while True:
        cut = graph.join(part.toDF("src", "_a"), "src").join(part.toDF("dst", "_b"), "dst").filter("_a <> _b")
        edge = F.struct("weight", "src", "dst")
        ends = cut.select(F.explode(F.array("_a", "_b")).alias("part"), edge.alias("e"))
        light = cut_lineage(ends.groupBy("part").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.weight").distinct())
        if light.isEmpty():
            return tree if tree is not None else graph.limit(0)
        tree = light if tree is None else cut_lineage(tree.unionByName(light))
        nodes = part.select("node")
        part = cut_lineage(connected_components(tree, nodes).toDF("node", "part"))
