"""Word-level byte-pair encoding with end-of-word symbols, piece by piece.

`WordBpe` reads a ``tokenizers`` file whose pipeline is *NFC, white space, lower case* then *split by a
pattern, byte level* then *BPE with an end-of-word suffix*. It gives the same ids as the library, but
keeps the three steps apart, so that a caller can cache words, cut long words and join them again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

#: Unicode white space, as the tokenizer's pattern has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Scripts in which this Python's and the library's Unicode tables agree on classes and case
#: (`tests/llm/test_operators.py` compares them code point by code point). Others are split by the library itself.
AGREED = "\\x00-\\u0557\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\u3001-\\u3003\\u3008-\\u3011\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class WordBpe:
    """Encodes texts as the library does with ``add_special_tokens=False``; special strings in a text are single tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.path = path
        conf = self._read()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pattern = next(p["pattern"]["Regex"] for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(pattern.replace(r"\s", WHITE)).findall
        self._other = re.compile(f"[^{AGREED}]").search
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self._symbol = dict(enumerate(byte_symbols()))
        self.suffix = conf["model"]["end_of_word_suffix"] or ""
        self._inside = None
        self.token = {i: t for t, i in conf["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}

    def _read(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    # -- text to words ---------------------------------------------------------------------------

    def plain(self, text: str) -> bool:
        """Whether `words` may be used: every code point is from an agreed script."""
        return text.isascii() or not self._other(text)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Text between special strings, and those strings (True)."""
        if self._special is None or "<" not in text:
            yield text, False
            return
        for k, part in enumerate(self._special.split(text)):
            if part:
                yield part, k % 2 == 1

    def words(self, segment: str) -> list[str]:
        """Words of a segment of a plain text: normalised, and split by the tokenizer's pattern."""
        if segment.isascii():
            return self._words(segment.lower())
        # the library lowers each character by itself, so there is no final sigma
        return self._words(unicodedata.normalize("NFC", segment).replace("Σ", "σ").lower())

    def symbols(self, word: str) -> str:
        return "".join(map(self._symbol.__getitem__, word.encode("utf-8")))

    def symbol_words(self, segment: str) -> list[str]:
        """Words of any segment in byte symbols, by the library's own normaliser and splitter."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))]

    # -- words to ids ----------------------------------------------------------------------------

    def piece(self, symbols: str, ends: bool) -> list[int]:
        """Ids of a run of byte symbols; `ends`: it reaches the end of its word."""
        if not symbols:
            return []
        if ends:
            return [t.id for t in self.library.model.tokenize(symbols)]
        if self._inside is None:
            from tokenizers import models

            m = self._read()["model"]
            self._inside = models.BPE(vocab=m["vocab"], merges=[tuple(x) for x in m["merges"]])
        return [t.id for t in self._inside.tokenize(symbols)]

    def text_of(self, ids: list[int]) -> str:
        return "".join(t.removesuffix(self.suffix) if self.suffix else t for t in map(self.token.__getitem__, ids))

    def join(self, left: list[int], right: list[int], ends: bool, window: int = 8) -> list[int]:
        """Ids of two neighbouring runs of one word, from the ids of each.

        The tokens around the join are encoded again in a window that grows until its first token is the
        left side's own and its last one the right side's own. A sequence is the encoding of its text if
        each two neighbours are the encoding of theirs, and then every two neighbours have been seen together.
        """
        while True:
            a, b = left[-window:], right[:window]
            whole_left, whole_right = window >= len(left), window >= len(right)
            middle = self.piece(self.text_of(a + b), ends and whole_right)
            if (whole_left or middle[0] == a[0]) and (whole_right or middle[-1] == b[-1]):
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            window *= 2

    def join_all(self, pieces: list[list[int]], ends: bool = True) -> list[int]:
        """Concatenate the encoded pieces of a word as a tree, neighbours first."""
        while len(pieces) > 1:
            last = len(pieces) - 1
            pieces = [self.join(pieces[k], pieces[k + 1], ends and k + 1 == last) if k < last else pieces[k] for k in range(0, len(pieces), 2)]
        return pieces[0] if pieces else []

    def tree(self, symbols: str, ends: bool = True, leaf: int = 4096) -> list[int]:
        """Ids of a run of any length, by halves."""
        if len(symbols) <= leaf:
            return self.piece(symbols, ends)
        middle = len(symbols) // 2
        return self.join(self.tree(symbols[:middle], False, leaf), self.tree(symbols[middle:], ends, leaf), ends)


class WordCache(dict):
    """What `make` gives for a word, kept for short words until there are too many."""

    def __init__(self, make: Callable[[str], object], most: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, read once in each Python process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
