"""Plain versions of the operators, over all documents of a small table."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(m: str) -> str:
    return re.sub("[^0-9]", "", m)


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only_digits(m.group())) <= 19 and luhn(only_digits(m.group()))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m.group())) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]


def spans(text: str, kinds, by_start: bool) -> str:
    out = [(m.start(), no, k, m.end()) if by_start else (no, m.start(), k, m.end()) for no, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return ",".join(f"{k}:{a if by_start else b}:{end}" for a, b, k, end in sorted(out))


def counts(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def without_shared_lines(docs: dict[int, str]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders: dict[str, set[int]] = {}
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs.items():
        lines = t.split("\n")
        stays = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stays), "\n".join(stays))
    return out


def shingles(text: str, size: int) -> frozenset:
    words = WORD.findall(text.translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def near_components(docs: dict[int, str], size: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, size) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in docs}
