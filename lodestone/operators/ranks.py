"""Ranks of rows that are too many to be sorted or kept, to so many digits as are asked for.

Ranks from 0 to 1 that are rounded to some digits have few values, and a row's value tells between which of the rows lies
where the value changes, the cuts. These are found exactly: cells of the values are counted, the rows of the cells
with a cut are ordered, and then each row is placed between the cuts. So the rows are made three times and never stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import cut_lineage, drop

#: Low bits that a cell leaves out of a value, and bits of a cell's number within its chunk: 2^26 cells from a power of two to the next.
LOW, WIDE = 26, 16
#: Rows that are ordered at once.
ORDERED = 1 << 18


class Cuts(NamedTuple):
    """The rows at which the rounded rank changes, in their order, and their ranks."""

    keys: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    ranks: np.ndarray


def _keys(column: pa.Array) -> np.ndarray:
    """Values as whole numbers in the same order; what isn't a number comes after the others, then nulls."""
    x = column.to_numpy(zero_copy_only=False) + 0.0  # no minus zero
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    bits = np.where(np.isnan(x), np.int64(0x7FF8 << 48), bits ^ (bits >> 63 & np.int64(2**63 - 1)))
    return np.where(column.is_null().to_numpy(zero_copy_only=False), np.int64(2**63 - 1), bits) if column.null_count else bits


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of the rows, in chunks: the places in it, in order, of two bytes each."""
    for batch in batches:
        cells = np.sort(_keys(batch.column(2)) >> LOW)
        if len(cells):
            starts = np.flatnonzero(np.append(True, np.diff(cells >> WIDE) != 0))
            places = np.split((cells & ((1 << WIDE) - 1)).astype(np.uint16), starts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(cells[starts] >> WIDE), pa.array([p.tobytes() for p in places], pa.binary())], ["chunk", "places"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows each cell has, of chunks that come with all their rows, one after another."""

    def row(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([int(total.sum())]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "n", "counts"])

    last, total = None, np.zeros(1 << WIDE, np.int64)
    for batch in batches:
        for chunk, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if last is not None and chunk != last:
                yield row(last, total)
                total = np.zeros(1 << WIDE, np.int64)
            last = chunk
            np.add.at(total, np.frombuffer(places.as_buffer(), np.uint16), 1)
    if last is not None:
        yield row(last, total)


def cuts(made: Callable[[Callable, str], DataFrame], digits: int) -> Cuts:
    """The rows at which the rank by ``distance``, ``src`` and ``dst``, from 0 to 1, changes when rounded to `digits`.

    `made` gives what a function from batches of rows (``src``, ``dst``, ``distance``) to batches, as `mapInArrow` takes, makes of all
    rows, with the schema of that. At most 10^digits + 1 of them, which the driver holds. Rows of the cells with a cut are
    shuffled once: with many more rows than values a small part of all, unless values are tied by the hundred.
    """
    counted = made(_counted, "chunk long, places binary").repartition("chunk").sortWithinPartitions("chunk")
    counted = cut_lineage(counted.mapInArrow(_summed, "chunk long, n long, counts binary"), release=True)
    sizes = sorted((r["chunk"], r["n"]) for r in counted.select("chunk", "n").collect())  # a row a chunk
    n = sum(size for _, size in sizes)
    nothing = np.empty(0, np.int64)
    if not n:
        drop(counted)
        return Cuts(nothing, nothing, nothing, np.empty(0))
    first = dict(zip((c for c, _ in sizes), np.cumsum([0, *(size for _, size in sizes)]).tolist(), strict=False))
    # the least ranks from 0 to n - 1 that are rounded to each value, halves upwards
    steps = 2 * np.arange(10**digits + 1) - 1
    at = np.unique(np.maximum(0, -(-steps * (n - 1) // (2 * 10**digits))))

    def with_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = np.frombuffer(zlib.decompress(counts), np.int64)
                ends = first[chunk] + np.cumsum(count)
                here = np.flatnonzero(np.searchsorted(at, ends) > np.searchsorted(at, ends - count))
                yield pa.RecordBatch.from_arrays([pa.array((chunk << WIDE) + here), pa.array((ends - count)[here]), pa.array(count[here])], ["cell", "before", "count"])

    found = counted.select("chunk", "counts").mapInArrow(with_cuts, "cell long, before long, count long").toArrow().sort_by("cell")  # at most one row a cut
    drop(counted)
    cells, before, count = (found[c].to_numpy() for c in ("cell", "before", "count"))
    earlier = np.cumsum(count) - count  # rows of cells with a cut, in earlier cells
    part = earlier // ORDERED
    heads = np.unique(part, return_index=True)[1]
    of_cut = np.searchsorted(before, at, "right") - 1
    places = at - before[of_cut] + earlier[of_cut]
    base = dict(zip(part[heads].tolist(), earlier[heads].tolist(), strict=True))

    def near_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column(2))
            where = np.minimum(np.searchsorted(cells, keys >> LOW), len(cells) - 1)
            hit = np.flatnonzero(cells[where] == keys >> LOW)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(part[where[hit]]), pa.array(keys[hit]), batch.column(0).take(pa.array(hit)), batch.column(1).take(pa.array(hit))], ["part", "key", "src", "dst"])

    def at_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([base[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy() - 1
            where = np.minimum(np.searchsorted(places, own), len(places) - 1)
            hit = places[where] == own
            yield pa.RecordBatch.from_arrays([pa.array(own[hit]), *(c.filter(pa.array(hit)) for c in batch.columns[2:])], ["place", "key", "src", "dst"])

    near = made(near_cuts, "part long, key long, src long, dst long")
    order = F.row_number().over(W.partitionBy("part").orderBy("key", "src", "dst")).cast("long")
    chosen = cut_lineage(near.select("part", order.alias("no"), "key", "src", "dst").mapInArrow(at_cuts, "place long, key long, src long, dst long"), release=True)
    table = chosen.toArrow().sort_by("place")
    drop(chosen)
    return Cuts(*(table[c].to_numpy() for c in ("key", "src", "dst")), at / max(1, n - 1))


def placed(cut: Cuts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches of rows to such with the rank of the last cut up to the row as ``distance``: it is rounded as the row's own rank is."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column(2))
            low, high = np.searchsorted(cut.keys, keys), np.searchsorted(cut.keys, keys, "right")
            tied = np.flatnonzero(low < high)
            if len(tied):  # cuts with the row's own value are told apart by src and dst
                src, dst, under, over = batch.column(0).to_numpy()[tied], batch.column(1).to_numpy()[tied], low[tied], high[tied]
                while len(left := np.flatnonzero(under < over)):
                    mid = (under[left] + over[left]) // 2
                    up = (cut.src[mid] < src[left]) | (cut.src[mid] == src[left]) & (cut.dst[mid] <= dst[left])
                    under[left[up]], over[left[~up]] = mid[up] + 1, mid[~up]
                high[tied] = under
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cut.ranks[high - 1]), *batch.columns[3:]], names=batch.schema.names)

    return place
