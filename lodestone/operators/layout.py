"""Two-dimensional places for the nodes of a graph, by rounds of joins over its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cut_lineage, drop
from ..functions.normalise import doubles, squared_distance
from .clusters import means_of
from .edges import both_ways, contract, degrees
from .linear import scores
from .sampling import uniform
from .traverse import coarsened


def diffusion_map(edges: DataFrame, *, rounds: int = 60, seed: int = 42) -> DataFrame:
    """``node``, ``x``, ``y``: the second and third eigenvectors of D^-½WD^-½ over √degree, by orthogonal iteration.

    Each round multiplies two columns by (I + D^-½WD^-½)/2, takes the first eigenvector (√degree) off, and makes
    them orthonormal; sums over nodes are all that meets in one place. For one connected component.
    """
    d = cut_lineage(degrees(edges, "weight").select("node", "degree"))
    around = both_ways(edges.select("src", "dst", "weight"))
    scaled = around.join(d.toDF("src", "da"), "src").join(d.toDF("dst", "db"), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))
    scaled = cut_lineage(scaled)
    v = d.select("node", F.sqrt("degree").alias("t"), (uniform(seed, F.lit(1), "node") - 0.5).alias("x"), (uniform(seed, F.lit(2), "node") - 0.5).alias("y"))
    for _ in range(rounds):
        moved = scaled.join(v.select(F.col("node").alias("dst"), "x", "y"), "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("x")).alias("mx"), F.sum(F.col("w") * F.col("y")).alias("my"))
        v = v.join(moved.withColumnRenamed("src", "node"), "node").select("node", "t", ((F.col("x") + F.col("mx")) / 2).alias("x"), ((F.col("y") + F.col("my")) / 2).alias("y"))
        v = cut_lineage(v)
        s = v.agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("tt", "tx", "ty", "xx", "xy", "yy"))).first()  # one row
        if s.tt is None:
            break
        px, py = s.tx / s.tt, s.ty / s.tt
        xx, xy, yy = s.xx - px * s.tx, s.xy - px * s.ty, s.yy - py * s.ty
        slope = xy / xx if xx > 0 else 0.0
        nx, ny = max(xx, 1e-300) ** 0.5, max(yy - slope * xy, 1e-300) ** 0.5
        x = F.col("x") - px * F.col("t")
        v = v.select("node", "t", (x / nx).alias("x"), ((F.col("y") - py * F.col("t") - slope * x) / ny).alias("y"))
    return v.select("node", (F.col("x") / F.col("t")).alias("x"), (F.col("y") / F.col("t")).alias("y"))


# The curve that turns a distance into an attraction.
CURVE_A, CURVE_B = 1.929, 0.7915


def attract_repel(edges: DataFrame, start: DataFrame, *, rounds: int = 50, negatives: int = 5, a: float = CURVE_A, b: float = CURVE_B, rate: float = 1.0, seed: int = 42) -> DataFrame:
    """``node``, ``x``, ``y``: neighbours pull by their weight, and keyed random nodes push, round by round.

    All nodes move at once from the last round's places, so the result doesn't depend on partitions. The
    nodes to push from are found by an equi-join on hashed places in the list of nodes.
    """
    nodes = cut_lineage(start.select("node", "x", "y"))
    n = nodes.count()
    if not n:
        return nodes
    around = cut_lineage(both_ways(edges.select("src", "dst", "weight")))
    for r in range(rounds):
        step = rate * (1 - r / rounds)
        here = nodes.toDF("src", "x", "y")
        pulled = around.join(here, "src").join(nodes.toDF("dst", "u", "v"), "dst")
        d2 = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
        pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(0.0) * F.col("weight")
        push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
        bins = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "node"), F.lit(n))
        asked = nodes.select(F.col("node").alias("src"), "x", "y", F.explode(F.transform(F.sequence(F.lit(1), F.lit(negatives)), lambda k: F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(r), "node", k), F.lit(n)))).alias("bin"))
        pushed = asked.join(nodes.select(F.col("node").alias("dst"), F.col("x").alias("u"), F.col("y").alias("v"), bins.alias("bin")), "bin").filter("src <> dst")
        held = lambda force, p, q: F.greatest(F.least(force * (F.col(p) - F.col(q)), F.lit(4.0)), F.lit(-4.0))
        moves = pulled.select("src", held(pull, "x", "u").alias("dx"), held(pull, "y", "v").alias("dy")).unionByName(pushed.select("src", held(push, "x", "u").alias("dx"), held(push, "y", "v").alias("dy")))
        total = moves.groupBy("src").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
        new = nodes.join(total.withColumnRenamed("src", "node"), "node", "left")
        nodes = cut_lineage(new.select("node", (F.col("x") + step * F.coalesce("dx", F.lit(0.0))).alias("x"), (F.col("y") + step * F.coalesce("dy", F.lit(0.0))).alias("y")))
    return nodes


def used_in(r: int, share: str | Column, seed: int, *keys: str) -> Column:
    """Whether an edge takes part in round `r`: as often as its `share` (0 to 1) of the rounds says, evenly spread.

    A counter that starts at a draw from `keys` grows by the share each round; the edge is used when it passes a whole
    number. So after any number R of rounds it has been used R · share times, give or take less than one.
    """
    share = F.col(share) if isinstance(share, str) else share
    start = uniform(seed, *keys)
    return F.floor((r + 1) * share + start) > F.floor(r * share + start)


def sampled_layout(
    edges: DataFrame, start: DataFrame, *, rounds: int = 200, negatives: int = 5, a: float = CURVE_A, b: float = CURVE_B, rate: float = 1.0, seed: int = 42,
) -> DataFrame:
    """``node``, ``x``, ``y``: in each round a share of the edges pulls its ends together, and each end is pushed from drawn nodes.

    An edge is used as often as its weight's share of the largest says (`used_in`), and then counts in full; each of
    its ends is pushed by `negatives` nodes. All nodes move at once, from the last round's places and by no more than 4, so the
    result doesn't depend on partitions. Nodes that are pushed from are found by an equi-join on hashed places in the list of nodes.
    """
    nodes = cut_lineage(start.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    n = nodes.count()
    most = edges.agg(F.max("weight")).first()[0]
    if not n or not most:
        return nodes
    shared = cut_lineage(edges.filter("src <> dst AND weight > 0").select("src", "dst", (F.col("weight") / most).alias("share")))
    held = lambda force, p, q: F.greatest(F.least(force * (F.col(p) - F.col(q)), F.lit(4.0)), F.lit(-4.0))
    d2 = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(0.0)
    push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
    for r in range(rounds):
        step = rate * (1 - r / rounds)
        used = both_ways(shared.filter(used_in(r, "share", seed, "src", "dst")).select("src", "dst"))
        here = nodes.toDF("src", "x", "y")
        pulled = used.join(here, "src").join(nodes.toDF("dst", "u", "v"), "dst")
        bins = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "node"), F.lit(n))
        drawn = F.explode(F.transform(F.sequence(F.lit(1), F.lit(negatives)), lambda k: F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(r), F.col("src"), F.col("dst"), k), F.lit(n))))
        asked = used.select("src", drawn.alias("bin")).join(here, "src")
        pushed = asked.join(nodes.select(F.col("node").alias("dst"), F.col("x").alias("u"), F.col("y").alias("v"), bins.alias("bin")), "bin").filter("src <> dst")
        moves = pulled.select("src", held(pull, "x", "u").alias("dx"), held(pull, "y", "v").alias("dy")).unionByName(pushed.select("src", held(push, "x", "u").alias("dx"), held(push, "y", "v").alias("dy")))
        total = moves.groupBy(F.col("src").alias("node")).agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
        moved = lambda p, d: (F.col(p) + step * F.greatest(F.least(F.coalesce(d, F.lit(0.0)), F.lit(4.0)), F.lit(-4.0))).alias(p)
        new = cut_lineage(nodes.join(total, "node", "left").select("node", moved("x", "dx"), moved("y", "dy")))
        drop(nodes)
        nodes = new
    drop(shared)
    return nodes


def start_at_random(nodes: DataFrame, seed: int = 42, width: float = 10.0) -> DataFrame:
    """``node``, ``x``, ``y``, drawn evenly from −`width` to `width`."""
    return nodes.select("node", *(((uniform(seed, F.lit(k), "node") * 2 - 1) * width).alias(c) for k, c in enumerate("xy")))


def start_from_scores(found: DataFrame, width: float = 10.0, jitter: float = 1e-4, seed: int = 42, vector: str = "scores") -> DataFrame:
    """``node``, ``x``, ``y``: the first two of each row's ``scores``, scaled so that the largest is `width`, with a little noise.

    Rows with one score have 0 as the other.
    """
    two = found.select(F.col("id").alias("node"), *(F.coalesce(F.get(vector, F.lit(k)), F.lit(0.0)).alias(c) for k, c in enumerate("xy")))
    most = two.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    return two.select("node", *((F.col(c) * (width / most) + (uniform(seed, F.lit(k), "node") * 2 - 1) * jitter * width).alias(c) for k, c in enumerate("xy")))


def place_members(
    points: DataFrame, membership: DataFrame, group_vectors: DataFrame, group_edges: DataFrame, group_places: DataFrame, *, nearest: int = 5, alpha: float = 10.0,
) -> DataFrame:
    """``node``, ``x``, ``y``: rows at the mean of the places of groups near them, weighed by exp(−(d/σ)^α).

    A row's candidates are its own group and those linked to it, so that it isn't put between groups that the graph
    keeps apart; d is its distance to a group's vector, σ the distance to the `nearest`-th candidate (the farthest, if
    there are fewer). Where all weights vanish the nearest candidate has all. `points` has ``id``, ``features``, `membership`
    ``node``, ``label``, `group_vectors` ``label``, ``mean``, `group_places` ``node``, ``x``, ``y``. Rows without a group
    aren't placed.
    """
    around = both_ways(group_edges.select("src", "dst")).toDF("label", "group").unionByName(group_places.select(F.col("node").alias("label"), F.col("node").alias("group"))).distinct()
    of = group_vectors.select(F.col("label").alias("group"), "mean").join(group_places.withColumnRenamed("node", "group"), "group")
    near = points.select(F.col("id").alias("node"), doubles(F.col("features")).alias("v")).join(membership, "node").join(around, "label").join(of, "group")
    near = near.select("node", F.sqrt(squared_distance(F.col("v"), F.col("mean"))).alias("d"), "x", "y")
    # as many as a group has links
    met = near.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "x", "y"))).alias("c"))
    sigma = F.element_at("c", F.least(F.size("c"), F.lit(nearest)))["d"]
    least = F.element_at("c", 1)["d"]
    # the nearest one's exponent is taken off, which leaves the means as they are and keeps one weight at 1
    power = lambda d: F.when(sigma > 0, F.pow(d / sigma, F.lit(alpha))).otherwise(0.0)
    weighed = F.transform("c", lambda t: F.struct(F.exp(power(least) - power(t["d"])).alias("w"), t["x"].alias("x"), t["y"].alias("y")))
    sums = lambda pick: F.aggregate("w", F.lit(0.0), lambda s, t: s + pick(t))
    out = met.select("node", weighed.alias("w"))
    return out.select("node", (sums(lambda t: t["w"] * t["x"]) / sums(lambda t: t["w"])).alias("x"), (sums(lambda t: t["w"] * t["y"]) / sums(lambda t: t["w"])).alias("y"))


def multilevel_layout(
    points: DataFrame, edges: DataFrame, *, shrink: int = 8, fewest: int = 64, rounds: int = 100, refine: int = 20, nearest: int = 5, alpha: float = 10.0, seed: int = 42,
) -> DataFrame:
    """``node``, ``x``, ``y`` of rows with vectors (``id``, ``features``) and the graph between them, from coarse to fine.

    The graph is coarsened by `shrink`, level by level, until `fewest` groups are left or none merge. The coarsest level
    starts at the leading two components of its groups' means and is laid out for `rounds`; then each level's nodes are
    placed by the groups near them and laid out for `refine` more rounds. So far ends of the graph find their places while
    there are few nodes, and the many only settle. Nodes without edges are groups of their own.
    """
    level = cut_lineage(points.select("id", doubles(F.col("features")).alias("features")))
    graph = cut_lineage(contract(edges, level.select(F.col("id").alias("node"), F.col("id").alias("label"))))
    levels = []
    n = level.count()
    while n > fewest:
        labels = coarsened(graph, level.select(F.col("id").alias("node")), max(fewest, n // shrink), seed=seed + len(levels))
        members = level.select(F.col("id").alias("node"), F.col("features").alias("v")).join(labels, "node")
        means = cut_lineage(means_of(members, "label"))
        fewer = means.count()
        if fewer == n:
            drop(labels, means)
            break
        levels.append((level, graph, labels, means))
        level, graph, n = means.select(F.col("label").alias("id"), F.col("mean").alias("features")), cut_lineage(contract(graph, labels)), fewer
    centre = np.array(level.select(F.posexplode("features").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k").select("m").collect(), float).ravel()
    centred = level.select("id", F.transform("features", lambda x, k: x - F.get(F.lit(centre.tolist()), k)).alias("features")) if n else level
    places = sampled_layout(graph, start_from_scores(scores(centred, 2, seed=seed), seed=seed), rounds=rounds, seed=seed)
    for k, (finer, finer_graph, labels, means) in enumerate(reversed(levels)):
        near = place_members(finer, labels, means, graph, places, nearest=nearest, alpha=alpha)
        jittered = near.select("node", *((F.col(c) + (uniform(seed + k, F.lit(j), "node") - 0.5) * 1e-3).alias(c) for j, c in enumerate("xy")))
        new = sampled_layout(finer_graph, jittered, rounds=refine, rate=0.25, seed=seed + 1 + k)
        drop(places, labels, means, graph)
        graph, places = finer_graph, new
    return places
