"""Refined communities and branchings: against brute force, planted groups, and other partitions."""

import itertools

import numpy as np
import pytest

from lodestone.operators import branching, refined


def graph_of(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "src long, dst long, weight double").repartition(partitions)


def nodes_of(spark, ids):
    return spark.createDataFrame([(k,) for k in ids], "node long")


def planted(groups, size, degree, mixing, seed):
    rng = np.random.default_rng(seed)
    n, rows = groups * size, []
    for _ in range(n * degree // 2):
        a = int(rng.integers(n))
        b = int(rng.integers(n)) if rng.random() < mixing else int(a // size * size + rng.integers(size))
        if a != b:
            rows.append((a, b, 1.0))
    return n, rows


def cpm(rows, labels, resolution):
    inner = sum(w for a, b, w in rows if labels[a] == labels[b])
    sizes = np.unique(list(labels.values()), return_counts=True)[1]
    return inner - resolution * float((sizes.astype(float) ** 2).sum()) / 2


def connected(rows, labels):
    parts = {}
    root = {k: k for k in labels}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b, _ in rows:
        if labels[a] == labels[b]:
            root[find(a)] = find(b)
    for k, label in labels.items():
        parts.setdefault(label, set()).add(find(k))
    return all(len(p) == 1 for p in parts.values()) and all(label == min(k for k in labels if labels[k] == label) for label in parts)


def test_communities_are_connected_and_no_worse_than_planted_ones(spark):
    n, rows = planted(8, 20, 12, 0.2, 0)
    found = refined.refined_communities(graph_of(spark, rows), nodes_of(spark, range(n)), resolution=0.1, passes=1)
    labels = dict(map(tuple, found.collect()))
    assert len(labels) == n and connected(rows, labels)
    assert cpm(rows, labels, 0.1) >= cpm(rows, {k: k // 20 for k in range(n)}, 0.1)
    again = refined.refined_communities(graph_of(spark, rows, 7), nodes_of(spark, range(n)).repartition(5), resolution=0.1, passes=1)
    assert dict(map(tuple, again.collect())) == labels


def test_a_community_that_falls_apart_is_split(spark):
    """Two cliques, a bridge node that starts with both: the parts can't stay together once it has gone."""
    clique = lambda s: [(s + a, s + b, 1.0) for a in range(5) for b in range(a + 1, 5)]
    rows = clique(0) + clique(10) + clique(20) + [(5, 0, 0.6), (5, 10, 0.6), *((5, 20 + k, 1.0) for k in range(5))]
    nodes = nodes_of(spark, [*range(5), 5, *range(10, 15), *range(20, 25)])
    start = spark.createDataFrame([(k, 20 if k >= 20 else 0) for k in [*range(5), 5, *range(10, 15), *range(20, 25)]], "node long, label long")
    labels = dict(map(tuple, refined.refined_communities(graph_of(spark, rows), nodes, resolution=0.3, start=start, passes=1).collect()))
    assert connected(rows, labels)
    assert labels[5] == labels[20] and labels[0] != labels[10] and labels[20] not in (labels[0], labels[10])


def test_communities_at_the_edges(spark):
    nodes = nodes_of(spark, [1, 2, 3])
    assert refined.refined_communities(graph_of(spark, [(9, 9, 1.0)]).limit(0), nodes).count() == 3
    assert refined.refined_communities(graph_of(spark, [(1, 1, 1.0), (2, 8, 1.0)]), nodes).select("label").distinct().count() == 3
    both = dict(map(tuple, refined.refined_communities(graph_of(spark, [(1, 2, 2.0), (2, 1, 2.0)]), nodes, objective="modularity").collect()))
    assert both == {1: 1, 2: 1, 3: 3}
    heavy = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 50.0)], "node long, size double")
    labels = dict(map(tuple, refined.refined_communities(graph_of(spark, [(1, 2, 1.0), (2, 3, 1.0)]), heavy, resolution=0.5, node_weight="size").collect()))
    assert labels == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        refined.refined_communities(graph_of(spark, [(1, 2, 1.0)]), nodes, objective="other")


def test_resolution_is_tuned(spark):
    n, rows = planted(4, 8, 10, 0.05, 4)
    found = refined.tuned(graph_of(spark, rows), nodes_of(spark, range(n)), 4, resolution=0.3, passes=1, tries=6)
    assert found.select("label").distinct().count() == 4


def best_branching(n, arcs, affinity):
    weight = {}
    for u, v, w in arcs:
        if u != v:
            weight[u, v] = max(w, weight.get((u, v), -np.inf))
    options = [[None, *(u for u in range(n) if (u, v) in weight)] for v in range(n)]
    best = -np.inf
    for parents in itertools.product(*options):
        for v in range(n):
            seen, at = set(), v
            while at is not None and at not in seen:
                seen.add(at)
                at = parents[at]
            if at is not None:
                break
        else:
            best = max(best, sum(affinity[v] if p is None else weight[p, v] for v, p in enumerate(parents)))
    return best


def is_forest(rows):
    parent = {r.node: r.parent for r in rows}
    for r in rows:
        at, steps = r.node, 0
        while parent[at] is not None:
            at, steps = parent[at], steps + 1
            assert steps <= len(parent)
        assert at == r.root


def test_branchings_by_brute_force(spark):
    """Many small graphs, side by side in one table, so that one run has them all."""
    rng = np.random.default_rng(7)
    arcs, nodes, want = [], [], []
    for g in range(60):
        n = int(rng.integers(1, 7))
        own = [(int(a), int(b), float(rng.integers(-4, 12))) for a, b in rng.integers(0, n, (int(rng.integers(0, 3 * n)), 2))]
        affinity = [float(x) for x in rng.integers(-3, 8, n)]
        arcs += [(100 * g + a, 100 * g + b, w) for a, b, w in own]
        nodes += [(100 * g + k, x) for k, x in enumerate(affinity)]
        want.append(best_branching(n, own, affinity))
    found = branching.max_branching(graph_of(spark, arcs), spark.createDataFrame(nodes, "node long, affinity double")).collect()
    is_forest(found)
    assert len(found) == len(nodes)
    affinity, got = dict(nodes), [0.0] * len(want)
    for r in found:
        got[r.node // 100] += affinity[r.node] if r.parent is None else r.weight
    assert got == want
    roots = sorted({r.root for r in found})
    assert {r.root: r.tree for r in found} == {k: i for i, k in enumerate(roots)}


def test_branchings_by_hand(spark):
    of = lambda arcs, affinity: {r.node: r.parent for r in branching.max_branching(graph_of(spark, arcs), spark.createDataFrame(list(enumerate(affinity)), "node long, affinity double")).collect()}
    assert of([(0, 1, 2.0), (1, 2, 2.0)], [0.0, 0.0, 0.0]) == {0: None, 1: 0, 2: 1}
    assert of([(0, 1, 2.0), (1, 2, 0.5)], [1.0, 1.0, 1.0]) == {0: None, 1: 0, 2: None}
    assert of([(0, 1, 1.0), (1, 0, 1.0)], [1.0, 1.0]) == {0: None, 1: None}  # a tie stays a root
    # cycles within cycles: 0 and 1, then with 2, then with 3
    nested = [(0, 1, 9.0), (1, 0, 9.0), (2, 0, 5.0), (1, 2, 6.0), (3, 2, 3.0), (0, 3, 4.0)]
    assert of(nested, [0.0, 0.0, 0.0, 1.0]) in ({0: None, 1: 0, 2: 1, 3: 0}, {0: 1, 1: None, 2: 1, 3: 0})
    # the heaviest of several arcs; loops and strangers are left out; nothing is an empty forest
    assert of([(0, 1, 1.0), (0, 1, 3.0), (1, 1, 9.0), (7, 0, 9.0)], [0.0, 2.0]) == {0: None, 1: 0}
    none = branching.max_branching(graph_of(spark, nested), spark.createDataFrame([], "node long, affinity double"))
    assert none.count() == 0


@pytest.mark.parametrize("few", [0, 40, 1 << 18])
def test_branchings_end_in_tasks(spark, monkeypatch, few):
    """A chain of links of growing length has a round for each link, which took a dozen jobs each; rounds on tables, in tasks, or both agree."""
    monkeypatch.setattr(branching, "FEW", few)
    chain = [(k, k + 1, -1.0 - k / 100) for k in range(8 if few == 0 else 30)]
    arcs = [*chain, *((b, a, w) for a, b, w in chain)]
    n = len(chain) + 1
    context = spark.sparkContext
    context.setJobGroup(f"branching {few}", "")
    found = branching.max_branching(graph_of(spark, arcs), spark.createDataFrame([(k, -10.0) for k in range(n)], "node long, affinity double")).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup(f"branching {few}"))
    context.setJobGroup("", "")
    is_forest(found)
    assert sorted(r.weight for r in found if r.parent is not None) == sorted(w for _, _, w in chain)
    assert few < 1 << 18 or jobs < 100


@pytest.mark.parametrize("few", [0, 6, 1 << 18])
def test_even_arcs_make_spanning_forests(spark, monkeypatch, few):
    """Arcs that weigh the same in either direction, with ties, copies of nodes and unlike roots, by Kruskal's steps on the nodes and a place for roots."""
    monkeypatch.setattr(branching, "FEW", few)
    rng = np.random.default_rng(11)
    links, affinity, want, worth = {}, {}, set(), {}
    for g in range(40):
        n = int(rng.integers(1, 12))
        own = {tuple(sorted(map(int, p))): -float(rng.integers(0, 4)) for p in rng.integers(0, n, (3 * n, 2)) if p[0] != p[1]}
        links |= {(100 * g + a, 100 * g + b): w for (a, b), w in own.items()}
        affinity |= {100 * g + k: float(x) for k, x in enumerate(rng.integers(-5, 1, n) if g % 2 else [-9.0] * n)}
    top = {x: x for x in [*affinity, None]}

    def part(x):
        while top[x] != x:
            x = top[x]
        return x

    keyed = [((-w, 1, a, b), a, b) for (a, b), w in links.items()] + [((-w, 0, k, k), k, None) for k, w in affinity.items()]
    for key, a, b in sorted(keyed, key=lambda e: e[0]):
        if part(a) != part(b):
            top[part(a)] = part(b)
            want.add((a, b))
            worth[a // 100] = worth.get(a // 100, 0.0) - key[0]
    arcs = [(a, b, w) for (a, b), w in links.items()] + [(b, a, w) for (a, b), w in links.items()]
    found = branching.max_branching(graph_of(spark, arcs), spark.createDataFrame(list(affinity.items()), "node long, affinity double")).collect()
    is_forest(found)
    assert {(r.node, None) if r.parent is None else (min(r.node, r.parent), max(r.node, r.parent)) for r in found} == want
    assert all(r.parent is None or r.weight == links[min(r.node, r.parent), max(r.node, r.parent)] for r in found)
    small = [g for g in worth if sum(k // 100 == g for k in affinity) < 6]
    for g in small:
        own = [(a - 100 * g, b - 100 * g, w) for a, b, w in arcs if a // 100 == g]
        assert worth[g] == best_branching(sum(k // 100 == g for k in affinity), own, [w for k, w in affinity.items() if k // 100 == g])
    assert len(small) > 5


def test_even_chains_take_few_rounds(spark, monkeypatch):
    """A chain of links of growing length and a hub with links of growing length took a round for each link."""
    monkeypatch.setattr(branching, "FEW", 0)
    links = [(k, k + 1, -1.0 - k / 100) for k in range(40)] + [(100, 101 + k, -1.0 - k / 100) for k in range(40)]
    context = spark.sparkContext
    context.setJobGroup("even chains", "")
    nodes = spark.createDataFrame([(k, -10.0) for k in [*range(41), *range(100, 141)]], "node long, affinity double")
    found = branching.max_branching(graph_of(spark, [*links, *((b, a, w) for a, b, w in links)]), nodes).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("even chains"))
    context.setJobGroup("", "")
    is_forest(found)
    assert sorted((min(r.node, r.parent), max(r.node, r.parent)) for r in found if r.parent is not None) == sorted((a, b) for a, b, _ in links)
    assert jobs < 150
