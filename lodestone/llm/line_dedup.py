"""Line deduplication: range-partitioned line hashes, streamed in order, answered with keep bitmaps.

Each document gives one row for each of its line keys: hash, document, positions. The rows are partitioned by
ranges of (hash, document) and sorted so within a partition, the largest document first; a run of one hash is
then read as a stream. Since the ranges cut through a hash with very many documents, the runs at a partition's
two ends may go on next door: their rows stay open, and what each partition knows of such a run (two rows a
partition at most) decides them afterwards. Text is never sorted; a document gets a compressed bitmap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut_lineage

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DROP, OPEN, PART = 0, 1, 2


def line_keys(text: bytes, least: int) -> dict[bytes, list[int]]:
    """Positions of each line key of at least `least` code points. bytes.strip() takes 0x20 and 0x09 to 0x0D."""
    found: dict[bytes, list[int]] = {}
    for k, line in enumerate(text.translate(LOWER).split(b"\n")):
        key = line.strip()
        if len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            found.setdefault(key, []).append(k)
    return found


def _hashes(docs: DataFrame, least: int) -> DataFrame:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                digests, docs_, texts, at = [], [], [], []
                for doc, text_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    keys = line_keys(text, least)
                    digests += map(xxhash.xxh3_128_digest, keys)
                    docs_ += [doc] * len(keys)
                    texts += [text_id] * len(keys)
                    at += keys.values()
                h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs_, pa.int64()), pa.array(texts, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["h1", "h2", "doc", "text_id", "at"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), _text_id(), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(extract, "h1 long, h2 long, doc long, text_id long, at array<int>")


def _text_id():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id")


def _stream(min_docs: int):
    """Reads sorted rows; gives rows to drop, rows of runs that may go on next door, and what is known of such runs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h1", "h2", "doc", "text_id", "at", "low", "n"]
        run, first_run, top, last, n, held = None, True, None, None, 0, []

        def out(kind, rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), *(pa.array(c, pa.list_(pa.int32()) if k == 4 else pa.int64()) for k, c in enumerate(columns)), *([pa.nulls(len(rows), pa.int64())] * (7 - len(columns)))], names)

        for batch in batches:
            h1, h2, doc = (batch.column(k).to_numpy() for k in range(3))
            rows = list(zip(h1.tolist(), h2.tolist(), doc.tolist(), batch.column(3).to_pylist(), range(batch.num_rows), strict=True))
            drop, open_ = [], []
            for a, b, d, text_id, k in rows:
                if (a, b) != run:
                    if run is not None and first_run:
                        yield out(PART, [(*run, top, None, None, last, n)])
                        first_run = False
                    run, top, last, n, held = (a, b), d, d, 1, []
                elif d != last:
                    last, n = d, n + 1
                if first_run:
                    open_.append((a, b, d, text_id, batch.column(4)[k].as_py()))
                elif d != top:
                    if n >= min_docs:
                        drop += held
                        held = []
                        drop.append((a, b, d, text_id, batch.column(4)[k].as_py()))
                    else:
                        held.append((a, b, d, text_id, batch.column(4)[k].as_py()))
            if drop:
                yield out(DROP, drop)
            if open_:
                yield out(OPEN, open_)
        if run is not None:
            yield out(PART, [(*run, top, None, None, last, n)])
            if held:
                yield out(OPEN, held)

    return read


def beyond_first(keys: DataFrame, min_docs: int) -> DataFrame:
    """``doc``, ``text_id``, ``at`` of the rows of `keys` that are not in the first document of their hash.

    `keys` has ``h1``, ``h2``, ``doc``, ``text_id``, ``at``; the largest ``doc`` is the first. Hashes in fewer
    than `min_docs` documents are left alone.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("text_id")]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    read = cut_lineage(ordered.mapInArrow(_stream(min_docs), "kind int, h1 long, h2 long, doc long, text_id long, at array<int>, low long, n long"))
    # documents strictly between the ends of a part are in no other part of the run
    ends = F.array_distinct(F.flatten(F.collect_list(F.array("doc", "low"))))
    runs = read.filter(F.col("kind") == PART).groupBy("h1", "h2").agg(F.max("doc").alias("top"), (F.size(ends) + F.sum(F.greatest(F.col("n") - 2, F.lit(0)))).alias("docs"))
    runs = runs.filter(F.col("docs") >= min_docs)
    # two runs a partition at most: small by construction
    settled = read.filter(F.col("kind") == OPEN).join(F.broadcast(runs), ["h1", "h2"]).filter(F.col("doc") != F.col("top"))
    return read.filter(F.col("kind") == DROP).select("doc", "text_id", "at").unionByName(settled.select("doc", "text_id", "at"))


def keep_bitmaps(docs: DataFrame, *, least: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id``, ``text_id``, ``n_dropped``, ``keep``: for each document that loses lines, a zlib-compressed bitmap.

    Bit k of ``keep`` (least significant first) is 1 if line k stays; lines past its end stay. A key of at
    least `least` code points in at least `min_docs` documents loses its lines in all but the largest
    ``doc_id``. A document is a ``doc_id``: rows that repeat one count once, and ``text_id`` tells its texts
    apart. Rows without ``doc_id`` count for nothing and lose nothing; null texts are one empty line.
    """
    drops = beyond_first(_hashes(docs, least), min_docs)
    return bitmaps_of(drops)


def bitmaps_of(drops: DataFrame) -> DataFrame:
    lost = drops.groupBy("doc", "text_id").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for at in batch.column(2).to_pylist():
                bits = np.ones((max(at) // 8 + 1) * 8, np.uint8)
                bits[at] = 0
                counts.append(len(at))
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "text_id", "n_dropped", "keep"])

    return lost.mapInArrow(pack, "doc_id long, text_id long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of `docs`, ``text`` without its dropped lines, with ``n_lines`` (before) and ``n_dropped``.

    Null texts stay null and have one line. Columns named like a result are replaced.
    """
    results = ("n_lines", "n_dropped")
    kept = [c for c in docs.columns if c not in results]
    names = [*kept, *results]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                at = batch.schema.names
                texts, total, gone = [], [], []
                for text, keep in zip(batch.column(at.index("text")).cast(pa.binary()).to_pylist(), batch.column(at.index("_keep")).to_pylist(), strict=True):
                    if keep is not None and text is not None:
                        lines = text.split(b"\n")
                        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
                        stays = [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]]
                        total.append(len(lines))
                        gone.append(len(lines) - len(stays))
                        texts.append(b"\n".join(stays))
                    else:
                        total.append(1 if text is None else text.count(b"\n") + 1)
                        gone.append(0)
                        texts.append(text)
                columns = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(at.index(c)) for c in names], names)

    marks = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), F.col("keep").alias("_keep"))
    joined = docs.select(*kept, _text_id().alias("_text_id"))
    joined = joined.join(marks, (joined["doc_id"] == marks["_doc"]) & (joined["_text_id"] == marks["_text"]), "left").select(*kept, "_keep")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return joined.mapInArrow(cut, f"{schema}, n_lines long, n_dropped long")
