"""Plain versions of the operations, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def near_duplicates(rows, size, percent=80):
    """id -> (set size, smallest linked id), over all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = set(windows(w, size)) if len(w) >= size else ({tuple(w)} if w else set())
    holders, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, x in sets.items():
        common = Counter(j for g in x for j in holders[g])
        for j, m in common.items():
            if 100 * m >= percent * (len(x) + len(sets[j]) - m):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in x:
            holders[g].append(i)
    return {i: (len(x), find(i)) for i, x in sets.items()}


def without_repeats(rows, size):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(g for _, w in split for g in windows(w, size))
    out = []
    for i, w in split:
        covered = {k for j, g in enumerate(windows(w, size)) if count[g] > 1 for k in range(j, j + size)}
        out.append((i, len(w), len(covered), " ".join(x for k, x in enumerate(w) if k not in covered)))
    return out


def contamination(docs, items, size=13):
    held = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        for g in windows(w, min(size, len(w))) if w else []:
            held[g].add(str(i))
    out = {}
    for d, t in docs:
        w = ALNUM.findall(lower(t or ""))
        hit, ids = set(), set()
        for n in {len(g) for g in held}:
            for k, g in enumerate(windows(w, n)):
                if g in held:
                    hit.update(range(k, k + n))
                    ids |= held[g]
        out[d] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def _digits(v):
    return re.sub("[^0-9]", "", v)


def _luhn(v):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(v)))) % 10 == 0


CHECKS = {
    "email": lambda v: True,
    "ip": lambda v: all(int(x) <= 255 for x in v.split(".")),
    "card": lambda v: 14 <= len(_digits(v)) <= 19 and _luhn(_digits(v)),
    "phone": lambda v: 10 <= len(_digits(v)) <= 15,
}


def base_spans(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if CHECKS[kind](m.group()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    count = Counter(windows(w, 3))
    covered = {k for j, g in enumerate(windows(w, 3)) if count[g] > 1 for k in range(j, j + 3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)
