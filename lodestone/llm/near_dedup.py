"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch is the `K` smallest hashes of its word shingles. Two sets with a similarity of 0.8 share
at least `SHARED` of the `K` smallest hashes of their union (fewer have a chance of 1e-10), so:

* inverted lists: a document may leave out its `SHARED` - `MEET` most frequent values: of the rest, taken in one
  order for all, a pair still shares `MEET`. The values fall in `MEET` - 1 classes by their hash, so a pair shares
  two of one class: the lists are those of two values of a class. Lists of common shingles are gone, and what
  meets in a list is mostly alike;
* short lists emit their pairs;
* a long list emits each member's pair with its head, the member with the most frequent values: in a group of
  copies that is the one in the middle, and the same one for all of the group's lists. Lists with one head are a
  family: of m members, it emits m pairs;
* union sketches estimate each pair's similarity; those below the bound go;
* exact Jaccard on the full sets, computed from the texts, confirms the rest;
* members of a family that are not linked to its head are compared with the whole family, in blocks of full sets
  of a bounded size, where an inverted list within the task counts what sets share. A block gives no more links
  than it has members.

Documents with equal sets are one class from the start, so exact copies are never paired. Rows that meet at a
head are joined by its id; Spark splits such a join where it is skewed (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import components, cut_lineage, drop, ranged
from .line_dedup import LOWER

K, SHARED = 40, 14
#: Sets of at most so many shingles only meet sets that lie within the sketch as a whole.
WHOLE = 32
#: Kept values that a similar pair shares at least; up to WHOLE, sets share as many for sure from `MEET` on.
MEET = 6
#: Smallest sets that share `MEET` for sure: 4/5 of them are so many.
TWO_FROM = 8
#: Lists of at most so many classes emit their pairs.
SHORT = 16
#: Most members and shingles of a block of a family (a set that is larger by itself is a block).
BLOCK_SETS, BLOCK = 512, 500_000


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `size` words; fewer words are one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) <= size:
        grams = [b" ".join(words)]
    elif size == 2:
        grams = [a + b" " + b for a, b in zip(words, words[1:], strict=False)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams)), np.int64))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc``, ``text_id``, ``n`` (set size), ``set_id`` (a digest of the set), ``sketch`` (its `K` smallest hashes)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, smallest = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, size)
                n.append(len(hashes))
                ids.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                smallest.append(hashes[:K])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(smallest, pa.list_(pa.int64()))], ["doc", "text_id", "n", "set_id", "sketch"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_id"), text.alias("text")).mapInArrow(sketch, "doc long, text_id long, n long, set_id binary, sketch array<long>")


def rare_lists(classes: DataFrame) -> DataFrame:
    """``value``, ``cid``, ``n``, ``score``: the inverted lists of two values that are needed.

    Sets of fewer than `MEET` shingles that must be shared keep all they have, in lists of one value. ``score``
    adds up in how many classes each of the sketch's values is.
    """
    postings = classes.filter("n > 3").select(F.explode("sketch").alias("value"), "cid", "n", F.size("sketch").alias("k"))
    shared = postings.groupBy("value").agg(F.count("*").cast("int").alias("classes")).filter("classes > 1")
    mine = postings.join(shared, "value").groupBy("cid").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sum("classes").alias("score"), F.array_sort(F.collect_list(F.struct("classes", "value"))).alias("values"))
    needed = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * 4 / 5)).otherwise(F.lit(SHARED)).cast("int")
    # values of one class are the rarest: they fill the first places, and no list needs them
    places = F.col("k") - needed + F.least(F.lit(MEET), needed) - (F.col("k") - F.size("values"))
    kept = mine.withColumn("values", F.slice(F.transform("values", lambda t: t["value"]), 1, F.greatest(places, F.lit(0))))

    def pairs_in(c: int):
        own = F.filter("values", lambda v: F.pmod(v, F.lit(MEET - 1)) == c)
        return F.flatten(F.transform(own, lambda v: F.transform(F.filter(own, lambda u: u > v), lambda u: F.xxhash64(v, u))))

    # a small set meets a slightly larger one, which may have lists of two: both kinds are made for sizes around
    small = F.when(F.col("n") < TWO_FROM, F.col("values"))
    around = F.when(F.col("n") <= TWO_FROM * 5 // 4 + 1, F.col("values"))
    none = F.array().cast("array<bigint>")
    twos = F.when(F.col("n") >= TWO_FROM, F.flatten(F.array(*(pairs_in(c) for c in range(MEET - 1))))).otherwise(none)
    keys = F.concat(F.coalesce(small, around, none), twos)
    return kept.select(F.explode(keys).alias("value"), "cid", F.col("n").cast("int").alias("n"), "score")


def _sizes_fit(n_a: str, n_b: str):
    return 5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)


def listed(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a``, ``b`` of short lists, and the members ``head``, ``head_n``, ``cid``, ``n`` of the long ones' families."""
    head = F.max(F.struct("score", "cid", "n")).alias("head")
    lengths = cut_lineage(lists.groupBy("value").agg(F.count("*").alias("m"), head).filter("m > 1"))
    short = lists.join(lengths.filter(F.col("m") <= SHORT).select("value"), "value").select("value", "cid", "n")
    pairs = short.toDF("value", "a", "n_a").join(short.toDF("value", "b", "n_b"), "value").filter((F.col("a") < F.col("b")) & _sizes_fit("n_a", "n_b"))
    long_ = lists.join(lengths.filter(F.col("m") > SHORT).select("value", F.col("head.cid").alias("head"), F.col("head.n").alias("head_n")), "value")
    return pairs.select("a", "b").distinct(), cut_lineage(long_.select("head", "head_n", "cid", "n").distinct())


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that may be similar enough by the sketch of their union."""
    own = classes.select("cid", "n", "sketch")
    both = pairs.join(own.toDF("b", "n_b", "s_b"), "b").join(own.toDF("a", "n_a", "s_a"), "a")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    whole = F.greatest("n_a", "n_b") <= K
    enough = F.when(whole, 5 * F.size(F.array_intersect("s_a", "s_b")) >= 4 * F.size(F.array_union("s_a", "s_b"))).otherwise(shared >= SHARED)
    return both.filter(_sizes_fit("n_a", "n_b") & enough).select("a", "b")


def texts_of(docs: DataFrame, needed: DataFrame, classes: DataFrame) -> DataFrame:
    """``cid``, ``text``: one text for each class in `needed`. Both sides are shuffled, at every size."""
    at = cut_lineage(classes.join(needed.distinct(), "cid").select("cid", F.col("one.doc").alias("doc"), F.col("one.text_id").alias("text_id")))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text")
    # rows may repeat a document
    texts = cut_lineage(rows.join(at.hint("merge"), ["doc", "text_id"]).dropDuplicates(["doc", "text_id"]).select("cid", "text"))
    drop(at)
    return texts


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs whose full sets have a similarity of 0.8 or more."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                keep = []
                for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                    if a != last:
                        last, left = a, shingle_hashes(x, size)
                    right = shingle_hashes(y, size)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    keep.append(100 * both >= 80 * (len(left) + len(right) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _within_families(families: DataFrame, links: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links ``a``, ``b`` of members that are not linked to the head of their family with other members.

    With P blocks of members and Q blocks of those, a set is copied Q times, and P times as one to be compared.
    """
    to_head = links.select(F.col("a").alias("head"), F.col("b").alias("cid"), F.lit(True).alias("linked"))
    members = families.join(to_head, ["head", "cid"], "left").select("head", "cid", "n", (F.col("linked").isNull() & (F.col("head") != F.col("cid"))).alias("loose"))
    members = cut_lineage(members)
    blocks = lambda m, n: F.ceil(F.greatest(m / F.lit(BLOCK_SETS), n / F.lit(BLOCK))).cast("int")
    loose = F.col("loose").cast("int")
    sizes = members.groupBy("head").agg(blocks(F.count("*"), F.sum("n")).alias("ps"), blocks(F.sum(loose), F.sum(loose * F.col("n"))).alias("qs")).filter("qs > 0")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_hashes(t or b"", size) for t in part.column(5).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.list_(pa.int64()))], ["head", "cid", "loose", "ps", "qs", "set"])

    whole = members.join(sizes, "head").join(texts, "cid").select("head", "cid", "loose", "ps", "qs", "text")
    whole = whole.mapInArrow(shingled, "head long, cid long, loose boolean, ps int, qs int, set array<long>")
    p, q = (F.pmod(F.xxhash64("cid"), F.col(c)).cast("int") for c in ("ps", "qs"))
    place = lambda a, b, asks: F.struct(a.alias("p"), b.alias("q"), F.lit(asks).alias("asks"))
    held = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda k: place(p, k, False))
    asked = F.when(F.col("loose"), F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda k: place(k, q, True)))
    placed = whole.select("head", F.explode(F.concat(held, F.coalesce(asked, F.array().cast("array<struct<p:int,q:int,asks:boolean>>")))).alias("at"), "cid", "loose", "set")
    placed = placed.select("head", "at.p", "at.q", "at.asks", "cid", "loose", "set")
    links = placed.groupBy("head", "p", "q").applyInArrow(_compared, "a long, b long")
    return links


def _compared(block: pa.Table) -> pa.Table:
    """Links between the members of a block and those that ask: of all similar pairs, a spanning forest."""
    asks = block["asks"].to_numpy()
    held, asking = block.filter(pa.array(~asks)), block.filter(pa.array(asks))
    a, b = [], []
    if held.num_rows and asking.num_rows:
        lists = held["set"].combine_chunks()
        flat, lengths = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ids = held["cid"].to_numpy()
        roots = np.where(held["loose"].to_numpy(), ids, block["head"][0].as_py())  # the others are linked to the head
        for x, mine in zip(asking["cid"].to_pylist(), asking["set"], strict=True):
            mine = mine.values.to_numpy()
            low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            hits = [owner[s:e] for s, e in zip(low.tolist(), high.tolist(), strict=True) if e > s]
            if not hits:
                continue
            both = np.bincount(np.concatenate(hits), minlength=len(ids))
            found = np.flatnonzero((100 * both >= 80 * (lengths + len(mine) - both)) & (ids != x))
            own = roots[ids == x]
            others, first = np.unique(roots[found], return_index=True)  # one link to each other component of the block
            new = others != (own[0] if len(own) else x)
            a += [x] * int(new.sum())
            b += ids[found[first[new]]].tolist()
            if len(others):
                least = min(int(others[0]), int(own[0])) if len(own) else int(others[0])
                roots[np.isin(roots, np.append(others, own))] = least
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id``, ``text_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of `docs`.

    Rows are linked if their sets of `size`-word shingles (A-Z lowered) have a similarity of 0.8 or more;
    ``component_id`` is the least ``doc_id`` that links reach, and ``kept`` says that it is the row's own. A
    row without words has an empty set and is linked with nothing; null texts are such rows. Rows that repeat
    a ``doc_id`` are told apart by ``text_id``, a hash of the text. A row without ``doc_id`` is left out of
    the comparison: it has no component and is kept. Other columns aren't looked at; no rows give no rows.
    Texts of any length are compared as a whole: one task holds the sets of the two texts of a pair.
    """
    known = cut_lineage(sketches(docs, size))
    # the class's text is any member's; its sketch is every member's
    grouped = known.filter("doc is not null and n > 0").groupBy("set_id", "n").agg(F.min(F.struct("doc", "text_id")).alias("one"), F.first("sketch").alias("sketch"))
    # the number of a class rises with its first document, so a component's least number has its least id
    classes = ranged(grouped, F.col("one")).withColumn("cid", F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_at"))
    lists = cut_lineage(rare_lists(classes))
    pairs, families = listed(lists)
    led = families.filter((F.col("cid") != F.col("head")) & _sizes_fit("n", "head_n")).select(F.col("head").alias("a"), F.col("cid").alias("b"))
    likely = cut_lineage(estimated(pairs.unionByName(led), classes))
    drop(lists)
    needed = likely.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(families.select("cid"))
    texts = texts_of(docs, needed, classes)
    links = cut_lineage(verified(likely, texts, size))
    # written, so that a task has one Python worker at a time
    more = cut_lineage(_within_families(families, links, texts, size))
    found = components(links.unionByName(more))
    drop(likely, texts, links, families, more)

    least = classes.select("cid", F.col("one.doc").alias("least"))
    roots = found.join(least.toDF("root", "component_id"), "root").select(F.col("node").alias("cid"), "component_id")
    of = classes.select("cid", "set_id", F.col("one.doc").alias("least")).join(roots, "cid", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id"))
    return (
        known.select("doc", "text_id", "n", "set_id")
        .join(of, "set_id", "left")
        .select(
            F.col("doc").alias("doc_id"),
            "text_id",
            F.col("n").alias("n_shingles"),
            F.when((F.col("n") == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the least ``doc_id`` stays.

    Of rows that repeat its id one stays, too. Rows without ``doc_id`` stay.
    """
    found = near_duplicates(docs, size).filter("kept")
    kept = found.groupBy("doc_id").agg(F.min("text_id").alias("_text")).filter("doc_id is not null").withColumnRenamed("doc_id", "_doc")
    rows = docs.filter("doc_id is not null").withColumn("_text_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    stays = rows.join(kept, (rows["doc_id"] == kept["_doc"]) & (rows["_text_id"] == kept["_text"])).dropDuplicates(["doc_id", "_text_id"])
    return stays.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
