"""Secrets in texts: assignments and key formats, and strings of high entropy.

A window slides over each candidate, a long run of key characters. The counts of its characters are kept, and with them
the sum of n * log2(n), as one character leaves and one enters; that gives the window's Shannon entropy. How many of its
characters are digits, small and capital letters is kept likewise, and tells the limit that the entropy must reach. A
candidate is a secret if one of its windows reaches its limit; windows that overlap a part on the allow-list don't count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

# The base patterns.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: The characters of candidates, and the class of each: digits, letters that are hexadecimal digits and other ones, small and capital, and the rest.
ALPHABET = "".join(map(chr, (*range(48, 58), *range(97, 123), *range(65, 91)))) + "+/_=-"
CLASSES = [0] * 10 + [1] * 6 + [2] * 20 + [3] * 6 + [4] * 20 + [5] * 5
#: Least entropy in bits of a window of digits and letters that are all hexadecimal, or all of one case; and of any other.
HEX_BITS, CASE_BITS, ANY_BITS = 3.0, 3.85, 3.9
#: Candidates that are no secret: numbers, words of letters, paths and identifiers made of such, UUIDs.
#: Repeated groups are possessive: java.util.regex goes one call deeper for each repetition of others.
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Z]?[a-z]+$|^[A-Z]+$",
    r"^(?:[A-Za-z]++[-_/])++[A-Za-z]*+$",
    r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
#: Parts that no secret's window has in it: counted alphabets and placeholders.
ALLOWED_PARTS = r"(?i)abcdefgh|01234567|example|placeholder|changeme|x{6,}+"


def _slide(value: Column, window: int) -> Column:
    """struct<best, random>: the highest entropy of a window of `value`, and whether a window reaches its limit."""
    terms = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    kinds = F.array(*map(F.lit, CLASSES))
    term = lambda n: F.element_at(terms, n + 1)
    one = lambda yes: F.when(yes, 1).otherwise(0)
    # places in the alphabet; those that leave, 0 while the window fills up
    enters = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    leaves = F.concat(F.array_repeat(F.lit(0), window), enters)
    pairs = F.transform(enters, lambda c, i: F.struct(c.alias("enters"), F.get(leaves, i).alias("leaves"), (i >= window - 1).alias("full")))

    def step(acc: Column, x: Column) -> Column:
        goes, comes, counts = x["leaves"], x["enters"], acc["counts"]
        gone = F.when(goes > 0, F.get(counts, goes - 1)).otherwise(0)
        had = F.get(counts, comes - 1) - one(goes == comes)
        total = acc["total"] - F.when(goes > 0, term(gone) - term(gone - 1)).otherwise(0.0) + term(had + 1) - term(had)
        moved = F.transform(counts, lambda n, k: n + one(k + 1 == comes) - one(k + 1 == goes))
        kind_in, kind_out = F.get(kinds, comes - 1), F.when(goes > 0, F.get(kinds, goes - 1)).otherwise(-1)
        of = F.transform(acc["of"], lambda n, k: n + one(k == kind_in) - one(k == kind_out))
        return F.struct(moved.alias("counts"), of.alias("of"), total.alias("total"), acc["best"].alias("best"), acc["random"].alias("random"), x["full"].alias("full"))

    def judged(acc: Column) -> Column:
        bits = F.lit(math.log2(window)) - acc["total"] / window
        n = lambda k: F.get(acc["of"], F.lit(k))
        mixed = (n(0) > 0) & (n(0) < window)
        least = F.when(mixed & ((n(0) + n(1) == window) | (n(0) + n(3) == window)), HEX_BITS).when(mixed & ((n(0) + n(1) + n(2) == window) | (n(0) + n(3) + n(4) == window)), CASE_BITS).otherwise(ANY_BITS)
        best = F.when(acc["full"], F.greatest(acc["best"], bits)).otherwise(acc["best"])
        random = acc["random"] | (acc["full"] & (bits >= least))
        return F.struct(acc["counts"].alias("counts"), acc["of"].alias("of"), acc["total"].alias("total"), best.alias("best"), random.alias("random"), acc["full"].alias("full"))

    zeros = lambda n: F.array_repeat(F.lit(0), n)
    start = F.struct(zeros(len(ALPHABET)).alias("counts"), zeros(6).alias("of"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(False).alias("random"), F.lit(False).alias("full"))
    # a step's struct is made once and then judged: each lambda's argument is a value
    once = lambda acc, x: F.element_at(F.transform(F.array(step(acc, x)), judged), 1)
    return F.aggregate(pairs, start, once, lambda acc: F.struct(acc["best"].alias("best"), acc["random"].alias("random")))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any `window` characters in a row of `value`."""
    return _slide(value, window)["best"]


def is_random(value: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    pieces = F.filter(F.split(value, ALLOWED_PARTS), lambda p: F.length(p) >= WINDOW)
    return F.when(allowed, False).otherwise(F.exists(pieces, lambda p: _slide(p, WINDOW)["random"]))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``found`` of each row: array<struct<start, no, end, kind, value>>, by start and then kind.

    Kinds are those of `BASE`, then ``entropy`` for what only the sliding window finds. A null text is empty and
    has no spans, neither has a text without matches. Rows are scanned one by one: repeated rows and null ids
    each give a row, no rows give none; other columns aren't looked at. Work grows with a text's length.
    """
    accept = {"assign": lambda m: F.length(F.regexp_extract(m, BASE["assign"], 1)) >= 6, "entropy": is_random}
    seen = spans.find(docs.select("doc_id", "text"), "text", BASE | {"entropy": CANDIDATE}, accept, {"access": lambda t: t.contains("AKIA")})
    seen = seen.withColumn("_base", F.concat(*map(F.col, BASE))).withColumn("entropy", F.expr(spans.outside("entropy", "_base")))
    return seen.select("doc_id", spans.listed([*BASE, "entropy"], by_start=True).alias("found"))
