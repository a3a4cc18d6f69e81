"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table: the token counts of the pre-tokens that were frequent where the tokenizer was
made, its vocabulary's whole words. Tier two is a cache in each Python worker, filled by encoding what the table
misses. Texts are read once, and no pre-token is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordBpe, WordCache, default_path, loaded

#: Longest pre-token in the table, in bytes, and most pre-tokens: together the bound on the broadcast's size.
LONGEST, ENTRIES = 48, 65_536


def frequent_pre_tokens(bpe: WordBpe, entries: int = ENTRIES) -> dict[str, int]:
    """Token counts of the vocabulary's first `entries` whole words, in byte symbols."""
    words = (t.removesuffix(bpe.suffix) for _, t in sorted(bpe.token.items()) if bpe.suffix and t.endswith(bpe.suffix))
    short = [w for w in words if w and len(w) <= LONGEST][:entries]
    return {w: len(bpe.piece(w, True)) for w in short}


def count_tokens(docs: DataFrame, path: str | None = None, *, entries: int = ENTRIES) -> DataFrame:
    """All columns of `docs` that are not named so already, with ``n_bytes`` (UTF-8) and ``n_tokens`` of ``text``.

    `path` is the tokenizer's file. A null text counts as empty, with no bytes and no tokens. Rows are
    independent of each other: repeated rows and tied ids each get their own counts, an empty table gives an
    empty one, and a column named like a result is replaced. The broadcast holds at most `entries` pre-tokens
    of at most `LONGEST` bytes, whatever the size of the corpus; a cache is emptied when it is full. A very long
    text is counted by one task, word by word.
    """
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(loaded(path), entries))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "text")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = loaded(path), shared.value
        encoded = WordCache(lambda symbols: len(bpe.tree(symbols)))
        # the table answers first; what it misses goes to the worker's own cache
        cache = WordCache(lambda word: known.get(symbols := bpe.symbols(word)) or encoded[symbols])
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                n = 0
                for part, special in bpe.segments(text) if text else ():
                    if special:
                        n += 1
                    elif bpe.plain(part):
                        n += sum(map(cache.__getitem__, bpe.words(part)))
                    else:
                        n += sum(known.get(w) or encoded[w] for w in bpe.symbol_words(part))
                out.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in (*kept, "n_bytes")), pa.array(out, pa.int64())], [*kept, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(count, f"{schema}, n_tokens long")
