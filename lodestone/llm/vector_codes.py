"""Codes of vectors: each of a few equal parts is replaced by the nearest entry of a codebook, found by Lloyd's rounds.

The rounds are those of Yinyang k-means. The entries of a codebook are clustered into groups once. Between rounds a
row keeps, for each of its parts, its entry, an upper bound of the distance to it and one lower bound a group of the
distances to all other entries there. When entries move, the bounds move by as much; only the groups whose bound no
longer rules them out are looked at. Distances are compared as integers, so ties go to the lower entry exactly.

A round is one pass over the rows: its tasks write the rows with their new bounds, and beside them, in a partition of
their own, the sums of what they assigned. Codebooks are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut_lineage, drop, shared_folder, with_totals
from .vectors import integers, matrix, whole

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 8, 16, 6, 4096, 4
#: Components count as no more than this, so that an error of some hundred components fits a long.
LIMIT = 1 << 27


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd's over the entries themselves, started at evenly spread ones."""
    x = entries.astype(float)
    groups = max(1, min(groups, len(x)))
    centres = x[np.linspace(0, len(x) - 1, groups).astype(int)]
    for _ in range(5):
        of = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([x[of == g].mean(0) if (of == g).any() else centres[g] for g in range(groups)])
    return of


class Bounds:
    """One part of many rows: entries, upper bounds and a lower bound a group, as they are after a codebook has moved."""

    def __init__(self, x: np.ndarray, book: np.ndarray, group: np.ndarray):
        self.x, self.book, self.group = x, book, group
        self.groups = int(group.max()) + 1 if len(group) else 0

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = ((self.x[:, None] - self.book[None]) ** 2).sum(2)
        at = d.argmin(1)
        far = np.sqrt(d)
        own = far[np.arange(len(at)), at]
        far[np.arange(len(at)), at] = np.inf
        lower = np.stack([far[:, self.group == g].min(1, initial=np.inf) for g in range(self.groups)], 1)
        return at, _up(own), _down(lower)

    def moved(self, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same three after each entry has moved by at most its `drift`."""
        at = at.copy()
        upper = upper.astype(float) + drift[at]
        lower = lower.astype(float) - np.array([drift[self.group == g].max(initial=0.0) for g in range(self.groups)])
        open_ = np.flatnonzero(~(upper < lower.min(1)))
        if len(open_):
            upper[open_] = np.sqrt(((self.x[open_] - self.book[at[open_]]) ** 2).sum(1)) * (1 + 1e-12)
            open_ = open_[~(upper[open_] < lower[open_].min(1))]
        if len(open_):
            was = at[open_]
            was_d = ((self.x[open_] - self.book[was]) ** 2).sum(1)
            best, best_d = was.copy(), was_d.copy()
            looked = ~(upper[open_, None] < lower[open_])  # the groups that may hold an entry as near as the own one
            found = {}
            for g in range(self.groups):
                rows, entries = np.flatnonzero(looked[:, g]), np.flatnonzero(self.group == g)
                if not len(rows) or not len(entries):
                    continue
                d = ((self.x[open_[rows]][:, None] - self.book[entries][None]) ** 2).sum(2)
                found[g] = rows, entries, d
                k = d.argmin(1)
                near, near_d = entries[k], d[np.arange(len(rows)), k]
                better = (near_d < best_d[rows]) | (near_d == best_d[rows]) & (near < best[rows])
                best[rows[better]], best_d[rows[better]] = near[better], near_d[better]
            for g, (rows, entries, d) in found.items():
                far = np.sqrt(d)
                far[entries[None] == best[rows][:, None]] = np.inf
                lower[open_[rows], g] = far.min(1)
            left = (best != was) & ~looked[np.arange(len(was)), self.group[was]]  # left behind in a group that wasn't looked at
            lower[open_[left], self.group[was[left]]] = np.minimum(lower[open_[left], self.group[was[left]]], np.sqrt(was_d[left]))
            at[open_], upper[open_] = best, np.sqrt(best_d)
        return at, _up(upper), _down(lower)


def _up(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers that are no less."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(x), x, np.nextafter(x.astype(np.float32), np.float32(-np.inf))).astype(np.float32)


def _bytes(x: np.ndarray) -> pa.Array:
    """A row of bytes for each row of a matrix."""
    x = np.ascontiguousarray(x)
    size = x.itemsize * x.shape[1]
    offsets = np.arange(len(x) + 1, dtype=np.int64) * size
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _numbers(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def encode(
    points: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS,
    ident: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``label``, ``code`` (bytes, an entry a part) and ``error`` of each row with a whole vector; and the codebooks.

    A codebook (parts × entries × width of a part) starts as the parts of the `entries` rows with the smallest ids.
    Rows with a null vector or a null or non-finite component are left out; ids and labels may be null (null ids come
    last) and may repeat, each row has its code. Vectors shorter than the longest, and all if its length is no
    multiple of `parts`, are filled up with zeros; components beyond ±2^27 count as that. Of fewer rows than
    `entries` each starts an entry; an empty table gives an empty one, and no entries. Other columns aren't returned.
    """
    spark = points.sparkSession
    rows = points.select(F.col(ident).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(whole("v"))
    rows = rows.select("vec_id", "label", integers("v", scale, LIMIT).alias("v"))
    seen = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0)).alias("most")).first()
    sub = -(-seen.width // parts)
    width, kind = sub * parts, "<i2" if seen.most < 1 << 15 else "<i4"
    first = [r.v + [0] * (width - len(r.v)) for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, sub).transpose(1, 0, 2)
    label_kind = rows.schema["label"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {label_kind}, code binary, error long"), books
    of = np.stack([grouped(b, groups) for b in books])
    n_groups = int(of.max()) + 1
    schema = f"kind int, vec_id long, label {label_kind}, v binary, at binary, upper binary, lower binary, error long, sums array<long>"
    columns = [c.split()[0] for c in schema.split(", ")]

    def assign(books: np.ndarray, drift: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            types = None
            for batch in batches:
                n = batch.num_rows
                types = batch.column(1).type
                if not n:
                    continue
                if drift is None:
                    x = matrix(batch.column(2), width)
                else:
                    x = _numbers(batch.column(2), kind, width).astype(np.int64)
                    old_at = _numbers(batch.column(3), np.uint8, parts)
                    old_upper, old_lower = _numbers(batch.column(4), "<f4", parts), _numbers(batch.column(5), "<f4", parts * n_groups).reshape(n, parts, n_groups)
                at, upper, lower, error = np.empty((n, parts), np.uint8), np.empty((n, parts), "<f4"), np.full((n, parts, n_groups), np.inf, "<f4"), np.zeros(n, np.int64)
                for p in range(parts):
                    own = x[:, p * sub : p * sub + sub]
                    bounds = Bounds(own, books[p], of[p])
                    if drift is None:
                        got = bounds.first()
                    else:
                        got = bounds.moved(old_at[:, p].astype(int), old_upper[:, p], old_lower[:, p, : bounds.groups], drift[p])
                    at[:, p], upper[:, p], lower[:, p, : bounds.groups] = got
                    error += ((own - books[p][got[0]]) ** 2).sum(1)
                    for k in np.unique(got[0]):
                        sums[p, k] += own[got[0] == k].sum(0)
                    counts[p] += np.bincount(got[0], minlength=books.shape[1])
                none = pa.nulls(n, pa.list_(pa.int64()))
                state = [_bytes(x.astype(kind)), _bytes(at), _bytes(upper), _bytes(lower.reshape(n, -1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), *state, pa.array(error), none], columns)
            if types is not None:
                total = pa.array([np.concatenate([sums.ravel(), counts.ravel()]).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, types), *(pa.nulls(1, pa.binary()) for _ in range(4)), pa.nulls(1, pa.int64()), total], columns)

        return run

    state = rows
    drift = None
    for step in range(rounds + 1):
        source = state.select("vec_id", "label", "v") if drift is None else state.select("vec_id", "label", "v", "at", "upper", "lower")
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        source.mapInArrow(assign(books, drift), schema).write.partitionBy("kind").parquet(path)
        table = spark.read.schema(schema).parquet(path)
        table._written_to = path
        if drift is not None:
            drop(last)
        last, state = table, table.filter("kind = 0")
        if step == rounds:
            break
        flat = {r.pos: int(r.x) for r in table.filter("kind = 1").select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()}
        size = books.size
        moved = books.copy()
        for k, count in enumerate(flat[size + j] for j in range(books.shape[0] * books.shape[1])):
            if count and sub:
                moved.reshape(-1, sub)[k] = [flat[k * sub + j] // count for j in range(sub)]
        drift = np.sqrt(((moved - books) ** 2).sum(2)) * (1 + 1e-12)
        books = moved
    coded = cut_lineage(state.select("vec_id", "label", F.col("at").alias("code"), "error"))
    drop(last)
    return coded, books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of the codebooks' numbers in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """`coded` with ``label_error``: the errors of all rows with the same label added up, null labels together."""
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    return with_totals(coded, ["label"], label_error=total)
