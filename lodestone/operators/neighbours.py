"""Nearest neighbours of rows with vectors: exact in blocks, or by cells of a coarse clustering.

Distances are Euclidean. Ties go to the smaller id, a row isn't its own neighbour, and rows with values that
aren't finite come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.normalise import dot, doubles, squared_distance
from ..frames import cut_lineage, numbered
from .stats import floor_quantiles

BLOCK = 2048
#: Pairs that are made at once, of those of two parts.
PAIRS = 1 << 19
#: Rows and numbers that a task holds of either table.
ROWS, NUMBERS = 1 << 17, 1 << 23
OUT = "id long, other long, distance double"
#: Queries on which the number of probed cells is measured, the share of their true neighbours that must lie in
#: these cells, and the least number.
TRIED, REACHED, PROBES = 512, 0.95, 16


def _matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, float)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of an Arrow column as a matrix; what shorter ones lack isn't a number, nor are nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    there = np.arange(lengths.max(initial=0)) < lengths[:, None]
    x = np.full(there.shape, np.nan)
    x[there] = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    return x


def _kinds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each kind of equal rows, and the kind of each row."""
    if not x.size:
        return np.zeros(min(len(x), 1), int), np.zeros(len(x), int)
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, kind = np.unique(raw, return_index=True, return_inverse=True)
    return first, kind.ravel()


def _first_of_kind(kind: np.ndarray, most: int) -> np.ndarray:
    """Whether a row is among the first `most` of its kind."""
    order = np.argsort(kind, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(kind[order]) != 0)) if len(kind) else np.zeros(0, int)
    place = np.arange(len(kind)) - np.repeat(starts, np.diff(np.append(starts, len(kind))))
    out = np.empty(len(kind), bool)
    out[order] = place < most
    return out


def _improve(best_d: np.ndarray, best_i: np.ndarray, rows: np.ndarray, queries: np.ndarray, at: np.ndarray, points: np.ndarray) -> None:
    """Put those of `points` (places `at`, ascending) into the lists of `rows` that are nearer than what these hold.

    Squared distances by products only tell which points can be among the nearest, with room for rounding; these are
    scored by differences. Products are of 32 bits where that leaves few points, else of 64.
    """
    keep = best_d.shape[1]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        top = max(np.abs(points).max(initial=0), np.abs(queries[rows]).max(initial=0))
        scale = 2.0 ** -np.ceil(np.log2(top)) if top > 0 else 1.0
        middle = points.mean(0) if top < 1e100 else 0.0
        p = (points - middle) * scale
        lengths = (p * p).sum(1)
        wide = {np.float64: np.column_stack([p, lengths]).T}
        wide[np.float32] = wide[np.float64].astype(np.float32)
        # written over from step to step: new memory for each would cost more than the products
        widest = 2 * BLOCK
        scratch, under = np.empty(256 * widest), np.empty(256 * widest, bool)
        for start in range(0, len(rows), 256):
            mine = rows[start : start + 256]
            exact = queries[mine]
            q = (exact - middle) * scale
            own = (q * q).sum(1)
            turned = np.column_stack([-2 * q, np.ones(len(q))])
            room = {kind: 8 * (p.shape[1] + 8) * np.finfo(kind).eps * (own + lengths.max() + 1e-30) for kind in wide}
            kind, a, width = np.float32, 0, BLOCK
            while a < len(p):
                b = min(a + width, len(p))
                limit = (best_d[mine, -1] * scale) ** 2 - own
                unset = ~np.isfinite(limit)
                if kind is np.float32 and (64 * room[kind] > limit + own).any():
                    kind = np.float64
                size = len(mine) * (b - a)
                rough = np.matmul(turned.astype(kind), wide[kind][:, a:b], out=scratch.view(kind)[:size].reshape(len(mine), b - a))
                if unset.any() and b - a >= keep:
                    limit[unset] = np.partition(rough[unset], keep - 1, axis=1)[:, keep - 1] + room[kind][unset]
                if kind is np.float32:  # rounded upwards
                    limit = limit + np.abs(limit) * 1e-6
                met = np.less_equal(rough, (limit + room[kind]).astype(kind)[:, None], out=under[:size].reshape(rough.shape))
                r, c = np.divmod(np.flatnonzero(met), b - a)  # some ten times faster than np.nonzero over two axes
                for low in range(0, len(r), 1 << 17):
                    # whole rows, or parts of one
                    _merge(best_d, best_i, mine, exact, r[low : low + (1 << 17)], c[low : low + (1 << 17)] + a, at, points)
                a, width = b, min(2 * width, widest)


def _merge(best_d: np.ndarray, best_i: np.ndarray, mine: np.ndarray, exact: np.ndarray, r: np.ndarray, c: np.ndarray, at: np.ndarray, points: np.ndarray) -> None:
    d = np.sqrt(((points[c] - exact[r]) ** 2).sum(1))
    d = np.where(np.isfinite(d), d, np.inf)
    near = d <= best_d[mine[r], -1]
    r, c, d = r[near], c[near], d[near]
    if not len(r):
        return
    keep = best_d.shape[1]
    some, r = np.unique(r, return_inverse=True)
    to = mine[some]
    row = np.concatenate([np.repeat(np.arange(len(some)), keep), r])
    d = np.concatenate([best_d[to].ravel(), d])
    i = np.concatenate([best_i[to].ravel(), at[c]])
    order = np.lexsort((i, d, row))
    starts = np.searchsorted(row[order], np.arange(len(some)))
    first = order[(starts[:, None] + np.arange(keep)).ravel()].reshape(-1, keep)
    best_d[to], best_i[to] = d[first], i[first]


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, others: bool, homes: np.ndarray | None = None, visits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of `points` for each query, as (query id, id, distance) columns.

    With `homes`, the cells of the points, and `visits`, which of the cells a query visits, it meets the points of these only.
    Equal queries are searched once, and of equal points only as many are looked at as a list can hold.
    """
    nothing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(query_ids) or not len(ids):
        return nothing
    if queries.shape[1] != points.shape[1]:  # a side whose vectors are all shorter
        width = max(queries.shape[1], points.shape[1])
        queries, points = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan) for x in (queries, points))
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    homes = None if homes is None else homes[order]
    # a list has room for the query's own id, which is left out afterwards
    keep = k + (np.unique(ids, return_counts=True)[1].max() if others else 0)
    kind = _kinds(points)[1]
    stay = _first_of_kind(kind, keep)
    ids, points, homes = ids[stay], points[stay], None if homes is None else homes[stay]
    first, kind = _kinds(queries)
    queries, visits = queries[first], None if visits is None else visits[first]
    best_d, best_i = np.full((len(first), keep), np.inf), np.full((len(first), keep), len(ids))
    whole_p, whole_q = np.isfinite(points).all(1), np.isfinite(queries).all(1)
    for cell in [None] if homes is None else np.unique(homes):
        here = np.full(len(ids), True) if homes is None else homes == cell
        come = np.full(len(queries), True) if homes is None else visits[:, cell]
        at = np.flatnonzero(here & whole_p)
        if len(at) and (come & whole_q).any():
            _improve(best_d, best_i, np.flatnonzero(come & whole_q), queries, at, points[at])
        # what isn't finite is infinitely far, and comes in the order of ids
        for rows, odd in ((come & whole_q, here & ~whole_p), (come & ~whole_q, here)):
            last = np.flatnonzero(odd)[:keep]
            if len(last) and rows.any():
                rows = np.flatnonzero(rows)
                i = np.column_stack([best_i[rows], np.tile(last, (len(rows), 1))])
                d = np.column_stack([best_d[rows], np.full((len(rows), len(last)), np.inf)])
                order = np.lexsort((i, d), axis=1)[:, :keep]
                best_i[rows], best_d[rows] = np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
    found = best_i[kind]
    there = found < len(ids)
    other = ids[np.minimum(found, len(ids) - 1)]
    if others:
        there &= other != query_ids[:, None]
    there &= np.cumsum(there, axis=1) <= k
    return np.repeat(query_ids, there.sum(1)), other[there], best_d[kind][there]


def _best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _rows(points: DataFrame, ident: str, vector: str, *more: Column) -> DataFrame:
    """``id``, ``v``; single precision stays so until distances are taken, which halves what is shuffled."""
    v = F.col(vector)
    single = points.select(v.alias("v")).schema["v"].dataType.simpleString() == "array<float>"
    return points.select(F.col(ident).cast("long").alias("id"), (v if single else doubles(v)).alias("v"), *more)


def _shares(m: int, n: int, width: int, tasks: int) -> tuple[int, int]:
    """Into how many parts m queries, and n points, go: each is sent once for each part of the other.

    As few as tasks can hold, but at least so many that there are `tasks` pairs of parts, if parts have `BLOCK` rows.
    """
    held = max(BLOCK, min(ROWS, NUMBERS // max(1, width)))
    share = lambda count, least: max(1, -(-count // held), min(-(-count // BLOCK), least))
    queries = share(m, int(np.ceil(np.sqrt(tasks))))
    points = share(n, -(-tasks // queries))
    return share(m, -(-tasks // points)), points


def _part(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _blocked(left: DataFrame, right: DataFrame, k: int, others: bool) -> DataFrame:
    """Parts of the queries against parts of the points: a task holds one of each, and passes on k rows a query."""
    m = left.count()
    n, width = right.agg(F.count("*"), F.max(F.size("v"))).first()
    query_parts, parts = _shares(m, n, width or 1, 2 * left.sparkSession.sparkContext.defaultParallelism)
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = left.select("id", "v", _part(query_parts).alias("query_part"), numbers(parts).alias("part"))
    points = right.select("id", "v", numbers(query_parts).alias("query_part"), _part(parts).alias("part"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _nearest(a["id"].to_numpy(), _vectors(a["v"]), b["id"].to_numpy(), _vectors(b["v"]), k, others)
        return pa.table(dict(zip(("id", "other", "distance"), found, strict=True)))

    return _met(queries, points, query_parts * parts, search)


def _met(queries: DataFrame, points: DataFrame, pairs: int, search) -> DataFrame:
    """What `search` finds in each pair of parts; more tasks than pairs, so that few hold two."""
    a, b = (d.repartition(4 * pairs, "query_part", "part").groupBy("query_part", "part") for d in (queries, points))
    return a.cogroup(b).applyInArrow(search, OUT)


def exact(points: DataFrame, k: int, ident: str = "id", vector: str = "features") -> DataFrame:
    """``id``, ``rank``, ``other``, ``distance``: the `k` nearest others of each row."""
    rows = _rows(points, ident, vector)
    return _best(_blocked(rows, rows, k, True), k).select("id", "rank", "other", "distance")


def between(queries: DataFrame, points: DataFrame, k: int, ident: str = "id", vector: str = "features") -> DataFrame:
    """The `k` nearest of `points` for each of `queries`, another table; equal ids aren't left out."""
    left, right = (_rows(d, ident, vector) for d in (queries, points))
    return _best(_blocked(left, right, k, False), k).select("id", "rank", "other", "distance")


def nearest_centroids(points: DataFrame, centroids: np.ndarray, probes: int, vector: str = "v") -> Column:
    """Numbers of the `probes` nearest centroids of a vector, ties to the lower number."""
    table = F.array(*(F.struct(F.lit(k).alias("c"), F.array(*map(F.lit, map(float, row))).alias("m")) for k, row in enumerate(centroids)))
    scored = F.transform(table, lambda t: F.struct(squared_distance(F.col(vector), t["m"]).alias("d"), t["c"].alias("c")))
    return F.transform(F.slice(F.array_sort(scored), 1, probes), lambda t: t["c"])


def _probes_needed(rows: DataFrame, centroids: np.ndarray, k: int) -> int:
    if len(centroids) <= PROBES:
        return PROBES
    tried = cut_lineage(rows.orderBy(F.xxhash64("id"), "id").limit(TRIED))
    true = cut_lineage(_best(_blocked(tried, rows, k, True), k).filter(F.col("distance") < float("inf")).select("id", "other"))
    # bounded by TRIED * k
    near = rows.join(F.broadcast(true.select(F.col("other").alias("id")).distinct()), "id", "left_semi")
    vector = {r["id"]: r["v"] for d in (tried, near) for r in d.collect()}
    pairs = [(r["id"], r["other"]) for r in true.collect()]
    if not pairs:
        return PROBES
    ids = sorted(vector)
    v, at = _matrix([vector[i] for i in ids]), {i: n for n, i in enumerate(ids)}
    with np.errstate(invalid="ignore", over="ignore"):
        d = (v * v).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * v @ centroids.T
    order = np.argsort(np.where(np.isfinite(d), d, np.inf), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort([place[at[a], order[at[b], 0]] + 1 for a, b in pairs])
    return max(PROBES, int(needed[int(np.ceil(REACHED * len(needed))) - 1]))


def by_cells(points: DataFrame, k: int, cells: int | None = None, probes: int | None = None, ident: str = "id", vector: str = "features", seed: int = 20240517) -> DataFrame:
    """`exact`, but each row looks only in the `probes` nearest of about √n cells; with all of them it is exact.

    Cells are put together to parts of about as many rows as a task can hold, and a large cell is cut into several. A row
    is sent once to each part in which it visits cells, with their numbers. The centroids are fitted on
    at most 256 rows a cell; every row is indexed. Without `probes`, the number is what the data needs: the least,
    from `PROBES` on, with which `TRIED` rows (the first by a hash of the id) find `REACHED` of their true neighbours.
    """
    from .clusters import fit_centroids

    rows = points.select(F.col(ident).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))
    n = rows.count()
    cells = max(1, min(cells or int(np.ceil(np.sqrt(n))), n))
    centroids = fit_centroids(rows, cells, seed=seed, rounds=10, most_rows=256 * cells)
    if not len(centroids):
        return exact(points, k, ident, vector)
    probes = min(probes or _probes_needed(rows, centroids, k), cells)
    queries = _rows(points, ident, vector)
    kind = queries.schema["v"].dataType.simpleString()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_near_cells(batch.column(1), centroids, 1)[:, 0], pa.int32())], ["id", "v", "cell"])

    homes = queries.mapInArrow(home, f"id long, v {kind}, cell int")
    sizes = np.zeros(len(centroids), int)
    for row in homes.groupBy("cell").count().collect():  # a row for each cell
        sizes[row["cell"]] = row["count"]
    return _best(_visited(queries, n, homes, sizes, centroids, probes, k, True), k).select("id", "rank", "other", "distance")


def _near_cells(column: pa.Array, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the `probes` nearest centroids of each vector, the nearest first."""
    v = _vectors(column)
    v = np.pad(v, ((0, 0), (0, max(0, centroids.shape[1] - v.shape[1]))), constant_values=np.nan)
    with np.errstate(invalid="ignore", over="ignore"):
        d = (v * v).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * v @ centroids.T
    return np.argsort(np.where(np.isfinite(d), d, np.inf), axis=1, kind="stable")[:, :probes]


def _visited(left: DataFrame, m: int, homes: DataFrame, sizes: np.ndarray, centroids: np.ndarray, probes: int, k: int, others: bool) -> DataFrame:
    """The k nearest in the `probes` nearest cells of each of the `m` rows of `left`, of each part of the cells.

    `homes` has ``id``, ``v`` and ``cell``, and `sizes` of them in each cell; a cell of size 0 isn't read by the query.
    """
    vector, kind = left.schema["v"].dataType.simpleString(), homes.schema["v"].dataType.simpleString()
    n = int(sizes.sum())
    query_parts, parts = _shares(m, n, centroids.shape[1], 2 * left.sparkSession.sparkContext.defaultParallelism)
    # the first part of each cell, and in how many parts it lies; both grow with the cell's number
    held, part, filled = max(1, -(-n // parts)), 0, 0
    first, slices = np.zeros(len(sizes), int), np.maximum(1, -(-sizes // held))
    for cell, size in enumerate(sizes):
        if filled and filled + size > held:
            part, filled = part + 1, 0
        first[cell] = part
        part, filled = (part + int(slices[cell]), 0) if slices[cell] > 1 else (part, filled + int(size))
    parts = part + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                near = np.sort(_near_cells(some.column(1), centroids, probes), axis=1)
                row, cell = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                times = slices[cell]
                ends = np.cumsum(times)
                to = np.repeat(first[cell], times) + np.arange(ends[-1]) - np.repeat(ends - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                starts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(to) != 0)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(row[starts])) for c in (0, 1)), pa.array(to[starts], pa.int32()), lists], ["id", "v", "part", "cells"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first[cell] + batch.column(3).to_numpy() % slices[cell], pa.int32())], ["id", "v", "cell", "part"])

    queries = left.mapInArrow(go, f"id long, v {vector}, part int, cells array<int>").withColumn("query_part", _part(query_parts))
    dealt = homes.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("no")).mapInArrow(deal, f"id long, v {kind}, cell int, part int")
    points = dealt.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if a.num_rows and b.num_rows:
            at, lists = b["cell"].to_numpy(), a["cells"].combine_chunks()
            low, high = at.min(), at.max()
            asked, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            known = (asked >= low) & (asked <= high)
            visits = np.zeros((a.num_rows, high - low + 1), bool)
            visits[row[known], asked[known] - low] = True
            found = _nearest(a["id"].to_numpy(), _vectors(a["v"]), b["id"].to_numpy(), _vectors(b["v"]), k, others, at - low, visits)
        return pa.table(dict(zip(("id", "other", "distance"), found, strict=True)))

    return _met(queries, points, query_parts * parts, search)


def within(points: DataFrame, by: str, ident: str = "id", vector: str = "features", known: DataFrame | None = None, then: tuple[Callable, str] | None = None) -> DataFrame:
    """``src`` < ``dst``, ``distance`` of all pairs of rows with the same `by`, null where a vector or a component is.

    The rows of a value are dealt to parts of `BLOCK`, and a task holds two parts, so that a frequent value isn't one task.
    The result grows with the square of the rows of a value. With `known` (``src``, ``dst``, ``distance``, each pair once)
    there is a further column ``known``: its distance of the pair, null if it doesn't have it. With `then`, a function from
    batches to batches as `mapInArrow` takes and the schema of these, the result is what it makes of them where they are made.
    """
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)).alias("whole")
    rows = _rows(points, ident, vector, F.col(by).alias("by")).filter("by is not null").select("id", "by", "v", whole)
    sizes = rows.groupBy("by").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(sizes, "by").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = dealt.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).select("by", "part", "other", "id", "v", "whole")
    marked = known is not None  # a task can't hold a table
    if marked:
        ends = F.array(*(F.struct(F.col(x).alias("id"), F.struct(F.col(y).alias("id"), "distance").alias("to")) for x, y in (("src", "dst"), ("dst", "src"))))
        near = known.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.collect_list("e.to").alias("near"))
        left = left.join(near, "id", "left").select("by", "part", "other", "id", "v", "whole", "near")
    right = dealt.select("by", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("a"), F.col("part").alias("b"), "id", "v", "whole").toDF("by_", "part_", "other_", "id", "v", "whole")
    schema = "src long, dst long, distance double" + (", known double" if marked else "")
    made, schema = then or (iter, schema)
    types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    kinds = pa.schema([(name, types[kind]) for name, kind in map(str.split, schema.split(","))])

    def measure(a: pa.Table, b: pa.Table) -> pa.Table:
        once = bool(a.num_rows and b.num_rows and a.column("part")[0] == a.column("other")[0])
        a, b = a.sort_by("id"), b.sort_by("id")
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        x, y = _vectors(a["v"]), _vectors(b["v"])
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1])), constant_values=np.nan) for v in (x, y))
        # a row meets those from `starts` on
        starts = np.searchsorted(ids_b, ids_a, "right") if once else np.zeros(len(ids_a), int)
        whole_a, whole_b = (np.asarray(t["whole"].to_numpy(), bool) for t in (a, b))
        some = np.empty((256, width))
        if marked:
            near = a["near"].combine_chunks()
            of = np.repeat(np.arange(len(ids_a)), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False))
            near = near.flatten()
            place = np.searchsorted(ids_b, near.field("id").to_numpy())
            met = np.flatnonzero((place < len(ids_b)) & (place >= starts[of]))
            met = met[ids_b[place[met]] == near.field("id").to_numpy()[met]]
            of, place, old_far = of[met], place[met], near.field("distance").to_numpy()[met]

        def pairs(top: int, end: int) -> pa.RecordBatch:
            """Those of the rows from `top` to `end`."""
            counts = len(ids_b) - starts[top:end]
            begins = np.cumsum(counts) - counts
            far = np.empty(counts.sum())
            with np.errstate(invalid="ignore", over="ignore"):
                for n, start, begin in zip(range(top, end), starts[top:end].tolist(), begins.tolist(), strict=True):
                    for low in range(start, len(ids_b), 256):
                        mine = y[low : low + 256]
                        square = np.subtract(mine, x[n], out=some[: len(mine)])
                        np.multiply(square, square, out=square)
                        square.sum(1, out=far[begin + low - start : begin + low - start + len(mine)])
                np.sqrt(far, out=far)
            row = np.repeat(np.arange(top, end), counts)
            other = np.arange(len(far)) - np.repeat(begins - starts[top:end], counts)
            src, dst = ids_a[row], ids_b[other]
            null = None if whole_a.all() and whole_b.all() else ~(whole_a[row] & whole_b[other])
            out = {"src": np.minimum(src, dst), "dst": np.maximum(src, dst), "distance": pa.array(far, mask=null)}
            if marked:
                old, own = np.full(len(far), np.nan), slice(*np.searchsorted(of, [top, end]))
                old[begins[of[own] - top] + place[own] - starts[of[own]]] = old_far[own]
                out["known"] = pa.array(old, mask=np.isnan(old))
            return pa.RecordBatch.from_pydict(out)

        step = max(1, PAIRS // max(1, len(ids_b)))
        return pa.Table.from_batches(list(made(pairs(n, min(n + step, len(ids_a))) for n in range(0, len(ids_a), step))), kinds)

    return left.groupBy("by", "part", "other").cogroup(right.groupBy("by_", "part_", "other_")).applyInArrow(measure, schema)


# -- distances of given pairs ------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """0 if either length is 0."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def rms_distance(a: Column, b: Column) -> Column:
    """Root of the mean squared difference."""
    return F.sqrt(squared_distance(a, b) / F.size(a))


def hellinger(log_a: Column, log_b: Column) -> Column:
    """Between two distributions given as logarithms."""
    half = F.zip_with(log_a, log_b, lambda x, y: F.exp(x / 2) - F.exp(y / 2))
    return F.sqrt(dot(half, half) / 2)


def distance_quantile(points: DataFrame, q: float, distance=None, ident: str = "id", vector: str = "features", most_pairs: int = 200_000, seed: int = 42) -> DataFrame:
    """``quantile``: the value at place ⌊q(m − 1)⌋ of the distances of m pairs of different rows; null below two rows.

    All pairs, if there are no more than `most_pairs`; of a larger table that many, drawn from all rows one by one.
    """
    rows = cut_lineage(numbered(points.select(F.col(ident).alias("a"), doubles(F.col(vector)).alias("x")), F.col("a"), "no").select("no", "x"))
    n = rows.count()
    left, right = rows.toDF("i", "x"), rows.toDF("j", "y")
    if n * (n - 1) // 2 <= most_pairs:
        pairs = left.join(F.broadcast(right), F.col("i") < F.col("j"))  # some 600 rows
    else:
        place = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(m))
        drawn = rows.sparkSession.range(most_pairs).select(place(0, n).alias("i"), place(1, n - 1).alias("j"))
        drawn = drawn.withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("int"))
        pairs = drawn.join(left, "i").join(right, "j")
    far = pairs.select((distance or euclidean)(F.col("x"), F.col("y")).alias("d"))
    return floor_quantiles(far, [], "d", [q]).select("quantile")
