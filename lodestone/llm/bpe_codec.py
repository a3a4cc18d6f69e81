"""BPE encoding and decoding of whole texts, long ones in parallel pieces.

A short text is encoded where it is read. A long one is cut at white space, which no token crosses, and what
has no white space is cut anywhere; the pieces are encoded in parallel, and those of one word are joined as a
tree (`bpe.WordBpe.join`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordBpe, WordCache, default_path, loaded

TEXT, INSIDE, END, SPECIAL = 0, 1, 2, 3
_space = re.compile(r"[\t-\r ]")


def _encode(bpe: WordBpe, cache: WordCache, encoded: WordCache, text: str) -> list[int]:
    ids: list[int] = []
    for part, special in bpe.segments(text) if text else ():
        if special:
            ids.append(bpe.special[part])
        else:
            for word_ids in map(cache.__getitem__, bpe.words(part)) if bpe.plain(part) else map(encoded.__getitem__, bpe.symbol_words(part)):
                ids += word_ids
    return ids


def _caches(bpe: WordBpe) -> tuple[WordCache, WordCache]:
    """The ids of words, and of words in byte symbols."""
    return WordCache(lambda word: bpe.tree(bpe.symbols(word))), WordCache(bpe.tree)


def pieces_of(bpe: WordBpe, text: str, size: int) -> Iterator[tuple[int, str]]:
    """Kind and text of the pieces of a long text, in order; pieces are of about `size` characters."""
    start = 0
    while start < len(text):
        cut = _space.search(text, min(start + size, len(text)))
        end = cut.end() if cut else len(text)
        part, start = text[start:end], end
        if len(part) <= 2 * size:
            yield TEXT, part
            continue
        for run, special in bpe.segments(part):
            if special:
                yield SPECIAL, run
                continue
            for word in bpe.symbol_words(run):
                for k in range(0, len(word), size):
                    yield (END if k + size >= len(word) else INSIDE), word[k : k + size]


def decode(ids: list[int], bpe: WordBpe) -> str:
    """The library's decoding for a file without decoder: the tokens, special ones too, with one space between."""
    return " ".join(map(bpe.token.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str | None = None, *, long_text: int = 65_536, piece: int = 16_384) -> DataFrame:
    """``doc_id``, ``ids`` array<int> and ``decoded`` string of each row's ``text``.

    Texts of over `long_text` characters are cut into pieces of about `piece` characters, encoded by as many
    tasks. A null text is empty and gives no ids. Rows are independent: repeated rows and null or tied ids
    each give a row. An empty table gives an empty one; other columns are not looked at.
    """
    path = path or default_path()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    ids_type = pa.list_(pa.int32())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        caches = _caches(bpe)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                ids = [_encode(bpe, *caches, t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, ids_type), pa.array([decode(x, bpe) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for r in range(batch.num_rows):
                found = list(pieces_of(bpe, batch.column(1)[r].as_py(), piece))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[r].as_py()] * n, batch.column(0).type), pa.array([batch.column(2)[r].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())], ["doc_id", "row", "no", "kind", "part"])

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        caches = _caches(bpe)
        for batch in batches:
            ids = [_encode(bpe, *caches, t) if kind == TEXT else [bpe.special[t]] if kind == SPECIAL else bpe.piece(t, kind == END) for kind, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, ids_type)], ["doc_id", "row", "no", "kind", "ids"])

    def join(table: pa.Table) -> pa.Table:
        bpe, ids, word = loaded(path), [], []
        table = table.sort_by("no")
        for kind, part in zip(table["kind"].to_pylist(), table["ids"].to_pylist(), strict=True):
            if kind in (INSIDE, END):
                word.append(part)
                if kind == END:
                    ids += bpe.join_all(word)
                    word = []
            else:
                ids += part
        return pa.table({"doc_id": table["doc_id"].slice(0, 1), "ids": pa.array([ids], ids_type), "decoded": pa.array([decode(ids, bpe)])})

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {doc_type}, ids array<int>, decoded string"
    is_long = F.length("text") > long_text
    pieces = rows.filter(is_long).mapInArrow(cut, f"doc_id {doc_type}, row long, no int, kind int, part string")
    spread = pieces.repartition("row", "no").mapInArrow(encode_pieces, f"doc_id {doc_type}, row long, no int, kind int, ids array<int>")
    return rows.filter(~is_long).select("doc_id", "text").mapInArrow(encode, out).unionByName(spread.groupBy("row").applyInArrow(join, out))
