"""Document fingerprints by a randomised edit embedding.

All texts share random walks: at step j the walk reads the character it stands on (with its successor), and
shared random bits say whether it moves on. Two walks that have read the same text stand on the same character,
and walks parted by an edit soon meet again, so the edit distance of texts becomes the Hamming distance of what
the walks read. Each step adds a shared random sign for its character to one of `BITS` sums; the signs of the
sums are the fingerprint. Long texts are cut where their content says so, and each part has a walk of its own, so
that the number of steps in a row is bounded and an edit moves no cut but those beside it.

Bands of sampled bits find candidates, and the fingerprints' likeness verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import components, cut_lineage, drop, ranged

BITS, SYMBOLS, PERIOD = 256, 1024, 4096
#: Characters below which a text is walked again from its start, until there are so many.
SHORTEST = 512
#: A text is cut behind `SEEN` characters with a hash that `CUT` divides, after `LEAST` characters and at most `MOST`.
SEEN, CUT, LEAST, MOST = 8, 4_096, 512, 16_384
#: Bands and the bits that each samples, and the least likeness of documents that are linked.
BANDS, SAMPLED, ALIKE = 16, 24, 0.97
#: Lists of at most so many classes emit their pairs; longer ones are compared in blocks of so many classes.
SHORT, BAND_BLOCK = 16, 1_024
#: Characters embedded at a time.
AT_ONCE = 4_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers (splitmix64), the shared randomness."""
    with np.errstate(over="ignore"):
        z = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each step of a period and symbol whether the walk moves, and its sign; the end of a part has neither."""
    bits = _mixed(np.arange(PERIOD * SYMBOLS)).reshape(PERIOD, SYMBOLS)
    moves, signs = np.zeros((2, PERIOD, SYMBOLS + 1), np.int8)
    moves[:, :SYMBOLS], signs[:, :SYMBOLS] = bits & np.uint64(1), ((bits >> np.uint64(1)) & np.uint64(1)).astype(np.int8) * np.int8(2) - np.int8(1)
    return moves, signs


_shared: list[tuple[np.ndarray, np.ndarray]] = []
_odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _before(flat: np.ndarray) -> np.ndarray:
    """A hash of the `SEEN` characters before each place; 0 at the first ones."""
    h = flat * _odd[0]
    h ^= h >> np.uint64(29)
    for width, factor in zip((1, 2, 4), _odd[1:], strict=True):
        h = h[:-width] * factor + h[width:]
    h ^= h >> np.uint64(32)
    return np.concatenate([np.zeros(SEEN, np.uint64), h])


def _cuts(places: list[int], begin: int, end: int) -> list[int]:
    """Starts of the parts from `begin` to `end`, which `places` may cut."""
    starts = [begin]
    for at in [*places, end]:
        while at - starts[-1] > MOST:
            starts.append(starts[-1] + MOST)
        if at < end and at - starts[-1] >= LEAST:
            starts.append(at)
    return starts


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Characters of about `AT_ONCE` at a time, and the parts among them: start, end, text, and the hash before it."""

    def cut(held: list[tuple[int, str, int, bool]]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        flat = np.frombuffer("".join(t for _, t, _, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashes = _before(flat)
        places = np.flatnonzero((hashes >> np.uint64(20)) % np.uint64(CUT) == 0)
        parts, base = [], 0
        for owner, text, before, goes_on in held:
            begin, end = base + before, base + len(text)
            low, high = np.searchsorted(places, [begin + LEAST, end])
            starts = _cuts(places[low:high].tolist(), begin, end)
            ends = [*starts[1:], end][: len(starts) - goes_on]  # a last part that goes on comes again with what follows
            parts += [(s, e, owner, int(hashes[s]) if before or s > begin else 0) for s, e in zip(starts, ends, strict=False)]
            base = end
        return flat, parts

    held, total = [], 0
    for owner, text in enumerate(texts):
        if not text:
            continue
        text = text * (-(-SHORTEST // len(text)))
        at, before = 0, 0
        while len(text) - at + before > AT_ONCE:
            flat, parts = cut([(owner, text[at - before : at - before + AT_ONCE], before, True)])
            yield flat, parts
            at, before = at - before + parts[-1][1], SEEN
        held.append((owner, text[at - before :], before, False))
        total += len(held[-1][1])
        if total >= AT_ONCE:
            yield cut(held)
            held, total = [], 0
    if held:
        yield cut(held)


def _walked(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The `BITS` sums of the walk over each part."""
    if not _shared:
        _shared.append(_tables())
    moves, signs = _shared[0]
    symbols = flat * np.uint64(0x9E3779B1)
    alone = symbols[ends - 1]  # the last character of a part is read without a successor
    symbols[:-1] += flat[1:] * np.uint64(0x85EBCA6B)
    symbols[ends - 1] = alone
    symbols = np.insert(((symbols >> np.uint64(7)) % np.uint64(SYMBOLS)).astype(np.int16), ends, SYMBOLS)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    place = (starts + np.arange(len(starts)))[order]
    lengths = lengths[order]
    ends = place + lengths
    steps = 2 * lengths + 2 * np.sqrt(lengths).astype(np.int64)
    last = int(steps[0])
    active = np.searchsorted(-steps, -np.arange(last), side="left").tolist()
    random = _mixed(np.arange(last) + (1 << 40))
    bucket, flip = (random % np.uint64(BITS)).tolist(), ((random >> np.uint64(32)) & np.uint64(1)).tolist()
    sums = np.zeros((BITS, len(starts)), np.int32)
    for j in range(last):
        k = active[j]
        at = place[:k]
        read = symbols.take(at)
        row = j % PERIOD
        if flip[j]:
            sums[bucket[j], :k] += signs[row].take(read)
        else:
            sums[bucket[j], :k] -= signs[row].take(read)
        at += moves[row].take(read)
    inside = np.flatnonzero(place < ends)  # these walk on, each from its own last step
    while len(inside):
        step = steps[inside]
        random = _mixed(step + (1 << 40))
        read, row = symbols[place[inside]], step % PERIOD
        sign = np.where((random >> np.uint64(32)) & np.uint64(1), 1, -1)
        sums[(random % np.uint64(BITS)).astype(np.int64), inside] += (sign * signs[row, read]).astype(np.int32)
        place[inside] += moves[row, read]
        steps[inside] += 1
        inside = inside[place[inside] < ends[inside]]
    out = np.empty((len(starts), BITS), np.int32)
    out[order] = sums.T
    return out


def walk_sums(texts: list[str]) -> np.ndarray:
    """The `BITS` sums of each text.

    Those of a text's parts are added; a later part's are turned by the hash before it, so that parts which begin
    alike by chance don't add up.
    """
    sums = np.zeros((len(texts), BITS), np.int64)
    for flat, parts in _parts(texts):
        starts, ends, owners, hashes = zip(*parts, strict=True)
        starts, ends, owners, hashes = np.array(starts), np.array(ends), np.array(owners), np.array(hashes, np.uint64)
        walked = _walked(flat, starts, ends)
        turn = (np.arange(BITS) + (hashes >> np.uint64(20))[:, None] % np.uint64(BITS)).astype(np.int64) % BITS
        walked = np.take_along_axis(walked, turn, axis=1) * np.where(hashes >> np.uint64(40) & np.uint64(1), -1, 1)[:, None]
        np.add.at(sums, owners, walked)
    return sums


def embed(texts: list[str]) -> np.ndarray:
    """A fingerprint of `BITS` bits for each text, as rows of bytes."""
    return np.packbits(walk_sums(texts) > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of steps on which two walks agree, estimated from the angle that differing bits tell of."""
    differing = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * differing / BITS))


def band_bits() -> np.ndarray:
    """The bits that each band samples: (`BANDS`, `SAMPLED`)."""
    return np.argsort(_mixed(np.arange(BANDS * BITS) + (1 << 50)).reshape(BANDS, BITS), axis=1)[:, :SAMPLED]


def bands_met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bands in which two fingerprints agree."""
    same = np.unpackbits(a ^ b, axis=1) == 0
    return same[:, band_bits()].all(axis=2).sum(axis=1)


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by as much of the other's start."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next", "text", "edge", "part"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long, bands_next long, text string, edge int, part long"
DONE, FIRST, LAST = 0, 1, 2


def _compared(rows: list[tuple], follow: list[tuple]) -> list[tuple]:
    """Result rows for (doc, text, fingerprint) and those that follow them."""
    if not rows:
        return []
    changed = [edited(r[1], f[1]) for r, f in zip(rows, follow, strict=True)]
    new = embed(changed)
    own, after = np.stack([r[2] for r in rows]), np.stack([f[2] for f in follow])
    figures = zip(likeness(own, new).tolist(), likeness(own, after).tolist(), bands_met(own, new).tolist(), bands_met(own, after).tolist(), strict=True)
    return [(r[0], len(r[1]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), r[2].tobytes().hex(), n.tobytes().hex(), *x, None, DONE, None) for r, c, n, x in zip(rows, changed, new, figures, strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of `docs` its fingerprint, that of its edited text, their likeness (`NAMES` without the last three), and ``component``.

    ``component`` is the least ``doc_id`` among the documents that are `alike`.

    The next document is the next smaller ``doc_id``; after the least comes the largest, and a lone row is its
    own next. Rows that repeat a ``doc_id`` follow each other by a hash of their text, rows without one come
    last. A null text is empty; empty texts have equal fingerprints, as all equal texts have.

    Rows are partitioned by ranges of the id and read in order. Only a partition's last row needs a row of
    another partition, that partition's first: two rows a partition are joined afterwards.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor().decompress
        part, carry = TaskContext.get().partitionId(), None
        for whole in batches:
            ids, begin = whole.column(0).to_pylist(), 0
            sizes = whole.column(2).to_pylist()
            while begin < whole.num_rows:
                end, chars = begin + 1, sizes[begin]
                while end < whole.num_rows and chars + sizes[end] <= AT_ONCE:
                    chars += sizes[end]
                    end += 1
                texts = [unpack(t).decode("utf-8", "surrogatepass") if t else "" for t in whole.column(1).slice(begin, end - begin).to_pylist()]
                rows = list(zip(ids[begin:end], texts, embed(texts), strict=True))
                if carry is None:
                    yield _batch([_edge(rows[0], FIRST, part)])
                else:
                    rows.insert(0, carry)
                carry = rows[-1]
                if len(rows) > 1:
                    yield _batch(_compared(rows[:-1], rows[1:]))
                begin = end
        if carry is not None:
            yield _batch([_edge(carry, LAST, part)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(t) if t else b"" for t in texts], pa.binary()), *batch.columns[2:]], ["doc_id", "text", "n", "place"])

    def _edge(row: tuple, kind: int, part: int) -> tuple:
        return (row[0], None, None, row[2].tobytes().hex(), None, None, None, None, None, row[1], kind, part)

    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").desc_nulls_last(), F.col("place")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("n"), F.xxhash64(text).alias("place"))
    rows = rows.mapInArrow(pack, "doc_id long, text binary, n int, place long")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", "n")
    read_ = cut_lineage(ordered.mapInArrow(read, _SCHEMA))

    # two rows a partition: the order of the partitions needs their numbers only
    edges = read_.filter(F.col("edge") != DONE)
    parts = edges.select("part").distinct().withColumn("next", F.lead("part").over(W.orderBy("part")))
    parts = parts.withColumn("next", F.coalesce("next", F.min("part").over(W.partitionBy())))
    lasts = edges.filter(F.col("edge") == LAST).join(parts, "part").select("doc_id", "text", "fingerprint", "next")
    firsts = edges.filter(F.col("edge") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("text_b"), F.col("fingerprint").alias("print_b"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, a, print_a, b, print_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = [np.frombuffer(bytes.fromhex(x), np.uint8) for x in (print_a, print_b)]
                yield _batch(_compared([(doc, a, bits[0])], [(None, b, bits[1])]))

    closed = lasts.join(firsts, "next").select("doc_id", "text", "fingerprint", "text_b", "print_b").mapInArrow(close, _SCHEMA)
    prints = cut_lineage(read_.filter(F.col("edge") == DONE).unionByName(closed).select(*NAMES[:-3]))
    drop(read_)
    return prints.join(alike(prints), "fingerprint").select(*NAMES[:-3], "component")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cid``, the fingerprint as four longs, and the keys of its bands: the band's number and the bits that it samples."""
    at, powers = band_bits(), 1 << np.arange(SAMPLED, dtype=np.int64)
    for batch in batches:
        prints = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, BITS // 8)
        keys = np.unpackbits(prints, axis=1)[:, at] @ powers + (np.arange(BANDS) << 32)
        longs = np.ascontiguousarray(prints).view(np.int64).reshape(-1, BITS // 64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(longs[:, k]) for k in range(BITS // 64)), pa.array(list(keys), pa.list_(pa.int64()))], ["cid", *LONGS, "keys"])


LONGS = [f"f{k}" for k in range(BITS // 64)]


def alike(prints: DataFrame, least: float = ALIKE) -> DataFrame:
    """``fingerprint``, ``component``: what documents are alike, by their ``fingerprint`` and ``doc_id``.

    Two documents are linked if their fingerprints share a band and have a likeness of `least`; the component is
    the least ``doc_id`` that links reach. Equal fingerprints are one class from the start. The lists of a band's
    key emit their pairs if they are short; long ones are compared in blocks of `BAND_BLOCK` classes, and a pair
    of blocks gives the links of a spanning forest, never all its pairs. Rows without ``doc_id`` are classes, too,
    and a component of nothing else has none; no rows give no rows.
    """
    most = int(np.floor(BITS * np.arccos(least) / np.pi))
    grouped = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("head"))
    # the number of a class rises with its head, so a component's least number has its least id
    classes = ranged(grouped, F.col("head").asc_nulls_last(), F.col("fingerprint")).withColumn("cid", F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_at"))
    coded = classes.select("cid", "fingerprint").mapInArrow(_coded, f"cid long, {', '.join(f'{c} long' for c in LONGS)}, keys array<long>")
    keyed = coded.select("cid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    lists = cut_lineage(keyed.join(shared, "key"))
    short = lists.filter(F.col("m") <= SHORT).select("key", "cid")
    pairs = short.toDF("key", "a").join(short.toDF("key", "b"), "key").filter("a < b").select("a", "b").distinct()
    own = coded.select("cid", *LONGS)
    both = pairs.join(own.toDF("a", *(f"{c}_a" for c in LONGS)), "a").join(own.toDF("b", *(f"{c}_b" for c in LONGS)), "b")
    differing = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in LONGS)
    close = both.filter(differing <= most).select("a", "b")

    blocks = F.ceil(F.col("m") / F.lit(BAND_BLOCK)).cast("int")
    placed = lists.filter(F.col("m") > SHORT).withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("p"), F.greatest(k, F.col("own")).alias("q")))
    placed = placed.select("key", "cid", "own", F.explode(others).alias("at")).join(own, "cid").select("key", "at.p", "at.q", "own", "cid", *LONGS)

    def forest(block: pa.Table) -> pa.Table:
        bits = np.stack([block[c].to_numpy() for c in LONGS], axis=1)
        ids, at, p, q = (block[c].to_numpy() for c in ("cid", "own", "p", "q"))
        left, right = np.flatnonzero(at == p[0]), np.flatnonzero(at == q[0])
        roots, a, b = ids.copy(), [], []
        for k in left.tolist():
            near = right[np.bitwise_count(bits[right] ^ bits[k]).sum(axis=1) <= most]
            found, first = np.unique(roots[near], return_index=True)
            new = found != roots[k]
            a += [int(ids[k])] * int(new.sum())
            b += ids[near[first[new]]].tolist()
            roots[np.isin(roots, np.append(found, roots[k]))] = min(roots[k], found[0]) if len(found) else roots[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    far = placed.groupBy("key", "p", "q").applyInArrow(forest, "a long, b long")
    roots = components(close.unionByName(far))
    drop(lists)
    found = classes.join(roots.toDF("cid", "root"), "cid", "left").select("fingerprint", "head", "root")
    heads = classes.select(F.col("cid").alias("root"), F.col("head").alias("least"))
    linked = found.filter("root is not null").join(heads, "root").select("fingerprint", F.col("least").alias("component"))
    return found.filter("root is null").select("fingerprint", F.col("head").alias("component")).unionByName(linked)
