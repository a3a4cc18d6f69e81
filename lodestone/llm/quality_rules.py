"""Quality rules: counts that describe a text, and bands of its compression ratio.

zstandard's ratio (compressed bytes over bytes) is low for repetitive text and near or above one for text
without structure. Small inputs compress worse than large ones, so each length has limits of its own. They
hold for the whole text and for each chunk of a fixed length.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: (least bytes, lowest ratio, highest ratio): from each length on, the ratios that a text may have. Clean texts of
#: 10,000 documents have ratios from 0.54, 0.46, 0.42, 0.38 and 0.34 on; the limits are about two thirds of these.
BANDS = ((0, 0.0, 9.9), (200, 0.34, 1.00), (500, 0.30, 0.80), (1_000, 0.27, 0.74), (4_000, 0.25, 0.70), (16_000, 0.22, 0.70))
#: Bytes of a chunk, its lowest and highest ratio, and the share of a text's chunks that may be beyond.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 4_096, 0.22, 0.74, 0.25
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, LEVEL = 50, 50, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """`COUNTS` of a text in UTF-8. bytes' own white space is that of the contract: 0x20, 0x09 to 0x0D."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < n - 2:
            times, reach = Counter(windows), 0
            for k, w in enumerate(windows):
                if times[w] > 1:
                    repeated += k + 3 - max(reach, k)
                    reach = k + 3
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def within_bands(text: bytes, squeeze, bands=BANDS) -> tuple[float, float, bool]:
    """The whole text's ratio, the share of its chunks that are beyond the chunk limits, and the verdict."""
    if not text:
        return 1.0, 0.0, True
    ratio = len(squeeze(text)) / len(text)
    low, high = bands[bisect.bisect_right([b[0] for b in bands], len(text)) - 1][1:]
    chunks = [text[k : k + CHUNK] for k in range(0, len(text) - CHUNK + 1, CHUNK)]
    if chunks and len(text) % CHUNK:
        chunks.append(text[-CHUNK:])  # the rest, filled up from before
    odd = sum(not CHUNK_LOW <= len(squeeze(c)) / CHUNK <= CHUNK_HIGH for c in chunks)
    share = odd / len(chunks) if chunks else 0.0
    return ratio, share, low <= ratio <= high and share <= CHUNK_SHARE


def quality(docs: DataFrame, *, bands=BANDS, level: int = LEVEL) -> DataFrame:
    """The columns of `docs` with `COUNTS`, ``ratio``, ``odd_chunks``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than `MIN_WORDS` words, or over `MAX_REPEAT_PERCENT` of them in repeated windows of
    three words. ``kept``: not failed, and within the compression bands. A null text has no words, and so
    fails. Rows are judged one by one: repeated rows and tied ids get equal verdicts, an empty table gives an
    empty one, and columns of `docs` that are named like a result are replaced.
    """
    results = (*COUNTS, "ratio", "odd_chunks", "base_failed", "kept")
    kept = [c for c in docs.columns if c not in results]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.names.index("text")).cast(pa.binary()).to_pylist():
                counts = rule_counts(text or b"")
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                ratio, odd, fine = within_bands(text or b"", squeeze, bands)
                rows.append((*counts, ratio, odd, failed, fine and not failed))
            columns = list(zip(*rows, strict=True)) or [()] * len(results)
            types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*kept, *results])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*kept).mapInArrow(judge, f"{schema}, {', '.join(f'{c} long' for c in COUNTS)}, ratio double, odd_chunks double, base_failed boolean, kept boolean")
