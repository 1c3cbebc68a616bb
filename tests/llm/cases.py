"""Rows that every operator must bear, and brute-force versions."""

import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, kept boolean, shard int, slot string, th int, n int, label int, drop int, n_lines string"


def hard_rows():
    long = "word " * 40_000 + "x" * 50_000
    texts = [None, "", "   \n\t ", "one", "ein zwei drei", "same text here", "same text here", "same text here", long, "é漢😀 ünï code space\x0b\x00nul", "line a b c d e\nline a b c d e\n\nline a b c d f"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "same text here"), (None, "a row without a number"), (None, None), (3, "another text of three")]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, "r", "k", True, 1, "x", 2, 3, 4, 5, "n") for k, (i, t) in enumerate(rows)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def classes(rows, k, num, den):
    """doc_id -> size of the set and least doc_id that links reach, by comparing all that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for t in s:
            holders[t].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for t in s:
            for j in holders[t]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies(seed=5, groups=30):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([1, 2, 3, 5, 9, 11, 12, 20, 40, 80, 200, 600]))]
        for _ in range(pick.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(pick.randrange(0, 2 + len(w) // 25)):
                w[pick.randrange(len(w))] = pick.choice(vocabulary)
            if pick.random() < 0.3:
                w += [pick.choice(vocabulary) for _ in range(pick.randrange(0, 2 + len(w) // 15))]
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows) + k, t) for k, t in enumerate((None, "", "  ", "Abc É", "abc É"))]


def quality(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    """kind:start:end of the base spans."""
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)
