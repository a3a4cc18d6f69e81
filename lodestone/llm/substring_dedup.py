"""Repeated passages: chosen windows of words are hashed, grouped globally, and all but the earliest go.

Of every `NEXT` successive windows of `WINDOW` words the one with the least hash is chosen (winnowing), so the
choice depends on the words alone: two texts that share `RUN` words in a row share a chosen window, whatever
stands around them. A window that an earlier document (or an earlier place of the same one) has is a repeat. It
grows word by word while the words beside it are those beside the kept window; chosen windows are so close that
nothing more than `NEXT` - 1 words is ever left to grow. A run of repeated words goes if it has enough of them,
so that short phrases which many texts share by nature stay. A whole line of `LINE` code points is a unit too, and
a repeat of it goes at any number of words. Units are told apart by digests of 128 bits. Where a script has no spaces, each character counts as a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import _mixed
from ..frames import cut_lineage
from .line_dedup import LOWER

#: Words of the shortest run that goes, of a window, and the windows of which one is chosen.
RUN, WINDOW, NEXT = 16, 9, 8
#: Bits that stand for a word beside a window, their type, and how many such words a long holds.
BITS, SHORT, HELD = 16, "<u2", 4
SIDE = NEXT - 1
#: Code points of the shortest line that is a unit, and of the shortest run that goes.
LINE = 20
#: Bytes of the longest word that is hashed with the others of its text, by a sum of powers.
SUMMED = 64
#: Bytes of short texts that are hashed at a time.
TOGETHER = 1 << 16
WORDS = [f"c{k}" for k in range(-(-2 * SIDE // HELD))]
DROP, OPEN, PART = 0, 1, 2

_white = np.zeros(256, bool)
_white[[32, *range(9, 14)]] = True
_letters = _mixed(np.arange(256) + (1 << 41))
_factors = _mixed(np.arange(2 * WINDOW) + (1 << 42)).reshape(2, WINDOW) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of `values`, the same wherever the range lies."""
    power, inverse = _powers(1 << max(12, int(len(values)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)])])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts])


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words of a text in UTF-8."""
    edges = np.flatnonzero(np.diff((~_white[raw]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    # Thai, Lao, Burmese and Khmer, kana and ideographs: the first byte alone, or with the second one
    wide = np.flatnonzero(raw >= 0xE0)
    lead, second = raw[wide], np.append(raw, 0)[wide + 1]
    wide = wide[(lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & ((second <= 0x81) | (second >= 0x9E) & (second <= 0x9F)) | (lead == 0xF0) & (second >= 0xA0)]
    if not len(wide):
        return starts, ends
    single = np.zeros(len(raw), bool)
    single[wide] = True
    chars = np.flatnonzero(((raw & 0xC0) != 0x80) & ~_white[raw])
    alone = single[chars]
    begins = alone | np.append(False, alone[:-1])
    cuts = np.union1d(starts, chars[begins])
    return cuts, np.minimum(np.append(cuts[1:], len(raw)), ends[np.searchsorted(ends, cuts, side="right")])


class Units:
    """The words of lowered texts, laid end to end, and each text's units: its chosen windows and then its lines.

    A unit has two numbers in ``keys``, its ``text`` and the words from ``at`` to ``to``; ``first`` has the first unit of
    each text. Nothing reaches from one text into the next, and a text's units are the same whatever lies beside it.
    """

    def __init__(self, *texts: bytes, least_line: int = LINE):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        self.texts = len(texts)
        #: The first byte and the first word of each text.
        self.begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.starts, self.ends = words_of(raw)
        self.bounds = np.searchsorted(self.starts, self.begins)
        n, of = len(self.starts), np.repeat(np.arange(self.texts), np.diff(self.bounds))
        words = _ranges(_letters[raw], self.starts, self.ends)
        for k in np.flatnonzero(self.ends - self.starts > SUMMED).tolist():
            words[k] = xxhash.xxh3_64_intdigest(raw[self.starts[k] : self.ends[k]].tobytes())
        at, keys = self._windows(words, of)
        #: Bits of each word, with words that are none (0) between texts.
        self._short = np.zeros(n + SIDE * (self.texts + 1) + WINDOW, SHORT)
        self._short[np.arange(n) + SIDE * (of + 1)] = np.maximum(words >> np.uint64(64 - BITS), 1)
        #: Code points before each byte.
        self.points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        spaced = np.append(self.starts[1:] > self.ends[:-1], False)[:n]
        spaced[self.bounds[1:][np.diff(self.bounds) > 0] - 1] = False
        #: Code points before each word, with white space as single spaces.
        self.chars = np.append(0, np.cumsum(self.points[self.ends] - self.points[self.starts] + spaced))
        line = np.unique(np.append(0, np.searchsorted(self.starts, np.flatnonzero(raw == 10))))
        line = line[line < n]
        to = np.append(line[1:], n)[: len(line)]
        long_ = self.chars[to] - self.chars[line] - spaced[to - 1] >= least_line
        line, to = line[long_], to[long_]
        held = words.tobytes()
        digests = b"".join(xxhash.xxh3_128_digest(held[a:b]) for a, b in zip((8 * line).tolist(), (8 * to).tolist(), strict=True))
        text = of[np.append(at, line)]
        order = np.argsort(text, kind="stable")
        self.at, self.to, self.text = np.append(at, line)[order], np.append(at + WINDOW, to)[order], text[order]
        self.is_line = order >= len(at)
        self.keys = np.append(keys, np.frombuffer(digests, np.uint64).reshape(-1, 2), axis=0)[order]
        self.first = np.searchsorted(self.text, np.arange(self.texts + 1))

    @staticmethod
    def _windows(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the chosen windows, and their keys."""
        runs, count = len(words) - WINDOW - NEXT + 2, len(words) - WINDOW + 1
        if runs <= 0:
            return np.empty(0, np.int64), np.empty((0, 2), np.uint64)
        windows, second = (_mixed(sum(words[j : j + count] * f for j, f in enumerate(factors))) for factors in _factors)
        least, place = windows[:runs].copy(), np.arange(runs)
        for j in range(1, NEXT):
            less = windows[j : j + runs] < least
            place[less] = np.flatnonzero(less) + j
            np.minimum(least, windows[j : j + runs], out=least)
        chosen = np.zeros(count, bool)
        chosen[place[of[:runs] == of[WINDOW + NEXT - 2 :]]] = True
        at = np.flatnonzero(chosen)
        return at, np.stack([windows[at], second[at]], axis=1)

    def beside(self, units: np.ndarray) -> np.ndarray:
        """Bits of the words beside each of `units`, before and then after it, the nearest first; none beside a line."""
        out = np.zeros((len(units), HELD * len(WORDS)), SHORT)
        place = self.at[units] + SIDE * (self.text[units] + 1)
        for k, j in enumerate([*range(-1, -SIDE - 1, -1), *range(WINDOW, WINDOW + SIDE)]):
            out[:, k] = self._short[place + j]
        out[self.is_line[units]] = 0
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each distinct key of a text, and for each unit the number of its key."""
        one, two = self.keys.T
        order = np.argsort(one, kind="stable")
        same = one[order[1:]] == one[order[:-1]]
        if (same & (two[order[1:]] != two[order[:-1]])).any():
            order = np.lexsort((self.text, two, one))
            same = (self.keys[order[1:]] == self.keys[order[:-1]]).all(axis=1)
        new = np.append(True, ~same | (self.text[order[1:]] != self.text[order[:-1]]))[: len(one)]
        number = np.empty(len(one), np.int64)
        number[order] = np.cumsum(new) - 1
        return order[new], number


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Begins and ends of parts of `texts` that are laid end to end: about `TOGETHER` bytes, or one longer text."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > TOGETHER:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if texts:
        yield begin, len(texts)


KEYS = f"h1 long, h2 long, doc long, text_id long, at int, {', '.join(f'{c} long' for c in WORDS)}"


def _hashes(docs: DataFrame, least_line: int) -> DataFrame:
    """A row for each document and unit, with the words beside the unit's first place."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                texts = [text.translate(LOWER) for text in batch.column(2).cast(pa.binary()).to_pylist()]
                keys, row, at, beside = [], [], [], []
                for a, b in _parts(texts):
                    mine = Units(*texts[a:b], least_line=least_line)
                    first, _ = mine.distinct()
                    keys.append(mine.keys[first])
                    row.append(a + mine.text[first])
                    at.append(first - mine.first[mine.text[first]])
                    beside.append(mine.beside(first).view(np.int64))
                row = np.concatenate(row)
                doc, text_id = (batch.column(k).to_numpy()[row] for k in (0, 1))
                columns = [*np.concatenate(keys).view(np.int64).T, ~doc, text_id, np.concatenate(at).astype(np.int32), *np.concatenate(beside).T]  # the least id comes first
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc", "text_id", "at", *WORDS])

    text = F.coalesce("text", F.lit(""))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    return rows.mapInArrow(extract, KEYS)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted rows; gives rows to drop with the words beside the kept one, rows of the first hash, which may have begun next door, and what is known of the first and the last hash."""
    names = ["kind", "h1", "h2", "doc", "text_id", "at", *WORDS]
    first, top = None, None  # the partition's first hash; (h1, h2, doc, words beside) of the kept row of the present one

    def known(row: tuple) -> pa.RecordBatch:
        columns = [PART, *row[:3], None, None, *row[3:]]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k in (0, 5) else pa.int64()) for k, x in enumerate(columns)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, text_id, at, *beside = (c.to_numpy() for c in batch.columns)
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        if top is not None and top[:2] == (h1[0], h2[0]):
            new[0] = False
        begins = np.flatnonzero(new)
        if top is None:
            first = int(h1[0]), int(h2[0])
            yield known((*first, int(doc[0]), *(int(c[0]) for c in beside)))
        run = np.cumsum(new)  # 0: the run that the last batch left
        kept = [np.concatenate([[0 if top is None else top[k + 2]], c[begins]])[run] for k, c in enumerate((doc, *beside))]
        open_ = (h1 == first[0]) & (h2 == first[1])
        drop = (doc != kept[0]) & ~open_
        for kind, rows, words in ((DROP, drop, kept[1:]), (OPEN, open_, beside)):
            if rows.any():
                columns = [np.full(int(rows.sum()), kind, np.int32), *(c[rows].astype(c.dtype) for c in (h1, h2, doc, text_id, at, *words))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        top = (int(h1[-1]), int(h2[-1]), *(int(c[-1]) for c in kept))
    if top is not None and top[:2] != first:
        yield known(top)


def _repeats(keys: DataFrame) -> DataFrame:
    """``doc``, ``text_id``, ``at`` of the rows of `keys` that an earlier document has too, and the words beside its copy."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    read = cut_lineage(ordered.mapInArrow(_stream, f"kind int, {KEYS}"), release=True)
    tops = read.filter(F.col("kind") == PART).groupBy("h1", "h2").agg(F.max(F.struct("doc", *WORDS)).alias("top"))
    # two hashes a partition at most: small by construction
    settled = read.filter(F.col("kind") == OPEN).drop(*WORDS).join(F.broadcast(tops), ["h1", "h2"]).filter(F.col("doc") != F.col("top.doc"))
    return read.filter(F.col("kind") == DROP).select("doc", "text_id", "at", *WORDS).unionByName(settled.select("doc", "text_id", "at", *(F.col(f"top.{c}").alias(c) for c in WORDS)))


def _removed(mine: Units, marked: np.ndarray, beside: np.ndarray, least_words: int, least_line: int = LINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of words (text, first, end) that go, for the units `marked` which an earlier document has with these words `beside`."""
    first, same = mine.distinct()
    kept = first[same]  # the first place of the same unit
    earlier = np.full(len(first), -1)
    earlier[same[marked]] = np.arange(len(marked))
    other = earlier[same]
    repeats = np.flatnonzero((kept != np.arange(len(kept))) | (other >= 0))
    other = other[repeats]
    words = mine.beside(kept[repeats])
    words[other >= 0] = beside[other[other >= 0]]
    grown = (words == mine.beside(repeats)) & (words > 0)
    before, after = (np.cumprod(x, axis=1).sum(axis=1) for x in (grown[:, :SIDE], grown[:, SIDE : 2 * SIDE]))
    # a place that never goes lies between texts
    starts, ends = (x[repeats] + mine.text[repeats] for x in (mine.at, mine.to))
    size = len(mine.starts) + mine.texts
    lines = mine.is_line[repeats]
    a, b = _runs(_covered(size, starts - before, ends + after))
    text = np.searchsorted(mine.bounds + np.arange(mine.texts + 1), a, side="right") - 1
    enough = (b - a >= least_words) & (mine.chars[b - text] - mine.chars[a - text] >= least_line)
    a, b = _runs(_covered(size, np.append(a[enough], starts[lines]), np.append(b[enough], ends[lines])))
    text = np.searchsorted(mine.bounds + np.arange(mine.texts + 1), a, side="right") - 1
    return text, a - text, b - text


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    change = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(covered.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def remove_repeats(docs: DataFrame, *, least_words: int = RUN, least_line: int = LINE) -> DataFrame:
    """``doc_id``, ``n_units``, ``removed``, ``kept_text`` for each row of `docs`.

    ``removed`` is array<struct<start, end, words>>: the repeated passages in code points of the original text,
    end exclusive; ``kept_text`` is the rest. Texts are compared with A-Z lowered and white space as single
    spaces. The earliest place is that of the least ``doc_id``, and within it the first; rows that repeat a
    ``doc_id`` are one document. Rows without ``doc_id`` lose nothing to others, but to earlier places of their own
    text; null and empty texts have no units, an empty table gives no rows, other columns aren't looked at. Short texts
    are hashed many at a time; a very long one is hashed whole in one task, by arrays of its words, and its marks are one row.

    Repeats of fewer than `least_words` words or `least_line` code points stay, unless they are whole lines of
    `least_line` or more. Lower limits remove more: all whole lines at `least_line` 1, and runs down to the
    `WINDOW` words of a unit; a run of fewer than `RUN` words may have no chosen window in common and then stays.
    Words beside a window are compared by `BITS` bits: an end takes a word too many with a chance of 1 in 65,535.
    """
    marks = _repeats(_hashes(docs, least_line)).groupBy("doc", "text_id").agg(F.collect_list(F.struct("at", *WORDS)).alias("marks"))
    marks = marks.select((-F.col("doc") - 1).alias("_doc"), F.col("text_id").alias("_text"), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                offsets, marked = batch.column(2).offsets.to_numpy(), batch.column(2).values
                at, *longs = (marked.field(k).to_numpy(zero_copy_only=False) for k in range(1 + len(WORDS)))
                beside = np.stack(longs, axis=1).view(SHORT)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                rest, units, spans = list(texts), [], []
                for a, b in _parts(texts):
                    mine = Units(*(text.translate(LOWER) for text in texts[a:b]), least_line=least_line)
                    units.append(np.diff(mine.first))
                    low, high = offsets[a], offsets[b]
                    place = np.repeat(mine.first[:-1], np.diff(offsets[a : b + 1])) + at[low:high]
                    of, x, y = _removed(mine, place, beside[low:high], least_words, least_line)
                    start, end, origin = mine.starts[x], mine.ends[y - 1], mine.begins[of]
                    spans.append(np.stack([a + of, mine.points[start] - mine.points[origin], mine.points[end] - mine.points[origin], y - x]))
                    for no in np.unique(of).tolist():
                        text, k = texts[a + no], of == no
                        ends = [0, *np.stack([start[k], end[k]], axis=1).ravel() - mine.begins[no], len(text)]
                        rest[a + no] = b"".join(text[p:q] for p, q in zip(ends[::2], ends[1::2], strict=True))
                of, *fields = np.concatenate(spans, axis=1)
                struct = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in fields], ["start", "end", "words"])
                removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(units), pa.int64()), removed, pa.array(rest, pa.binary()).cast(pa.string())], ["doc_id", "n_units", "removed", "kept_text"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_text_id"))
    joined = rows.join(marks, (rows["doc_id"] == marks["_doc"]) & (rows["_text_id"] == marks["_text"]), "left").select("doc_id", "text", "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_units long, removed array<struct<start:int,end:int,words:int>>, kept_text string")
