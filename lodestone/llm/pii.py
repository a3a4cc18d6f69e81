"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

# The base patterns. Possessive, since what follows each run can't be one of its own characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Score of a confirmed span, and words that raise it when they stand within `NEAR` code points.
SCORES = {
    "email": (0.9, "mail|contact|write"),
    "ip": (0.6, "ip|address|host|server"),
    "card": (0.8, "card|visa|mastercard|amex|credit|payment"),
    "phone": (0.8, "phone|tel|call|fax|mobile|cell"),
    "iban": (0.9, "iban|bank|account|konto|cuenta|compte"),
    "ssn": (0.3, "ssn|social security|tax id"),
    "local_phone": (0.3, "phone|tel|call|fax|mobile|cell"),
}
NEAR, RAISE, LEAST = 40, 0.3, 0.5
#: Code points of the chunks in which a span's surroundings are looked up.
CHUNK = 1_024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def small_parts(m: Column) -> Column:
    """The four parts of a dotted number are at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.right(p, F.lit(3)).cast("int") <= 255).otherwise(False))


def mod_97(m: Column) -> Column:
    """An account number whose rearranged digits leave 1 when divided by 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    letter = lambda c: F.ascii(c) >= 65
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(letter(c), 100).otherwise(10) + F.when(letter(c), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97)
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(False)


ACCEPT = {
    "ip": small_parts,
    "card": lambda m: F.when(F.length(_digits(m)).between(13, 19), F.call_function("luhn_check", _digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": mod_97,
    "ssn": lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
}


def find_personal(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``found`` of each row: array<struct<no, start, end, kind, value, score>>, by kind and then start.

    Kinds are those of `BASE`, whose confirmed spans all count, then those of `MORE`, which count from a score of
    `LEAST` on. A null text is empty and has no spans. Rows are searched one by one: repeated rows and null ids
    each give a row, no rows give none; other columns aren't looked at. Work grows with a text's length.
    """
    may = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "ip": lambda t: t.contains("."), "ssn": lambda t: t.contains("-")}
    seen = spans.find(docs.select("doc_id", "text"), "text", BASE | MORE, ACCEPT, may)
    some = F.greatest(*(F.size(k) for k in (*BASE, *MORE))) > 0
    seen = seen.withColumn("_chunks", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def near(start: Column, n: Column) -> Column:
        """`n` code points of the text from `start` on, at most `CHUNK`: of two chunks, wherever in the text they lie."""
        no = F.floor(start / CHUNK).cast("int")
        two = F.concat(F.coalesce(F.get("_chunks", no), F.lit("")), F.coalesce(F.get("_chunks", no + 1), F.lit("")))
        return two.substr(start - no * CHUNK + 1, n)

    def score(s: Column, kind: str) -> dict[str, Column]:
        first = F.greatest(s["start"] - NEAR, F.lit(0))
        around = F.concat(near(first, s["start"] - first), s["value"], near(s["end"], F.lit(NEAR)))
        return {"score": F.lit(SCORES[kind][0]) + F.when(around.rlike(rf"(?i)\b(?:{SCORES[kind][1]})"), RAISE).otherwise(0.0)}

    found = spans.listed([*BASE, *MORE], score)
    return seen.select("doc_id", found.alias("found")).withColumn("found", F.filter("found", lambda s: s["kind"].isin(*BASE) | (s["score"] >= LEAST)))
