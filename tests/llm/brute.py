"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def spans(kinds, text):
    out = []
    for rank, (kind, pattern, keep) in enumerate(kinds):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if keep(m)]
    return sorted(out)


PII = (("email", EMAIL, lambda m: True),
       ("ip", IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
       ("card", CARD, lambda m: 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
       ("phone", PHONE, lambda m: 9 <= len(digits(m.group())) <= 15))
SECRETS = (("assign", ASSIGN, lambda m: len(m.group(2)) >= 6),
           ("access", ACCESS, lambda m: len(m.group()) >= 20),
           ("hex", HEX, lambda m: len(m.group()) >= 24))


def digest(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


_UP = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower(text):
    return text.encode().translate(_UP).decode()


def decontaminate(docs, bench, window=10):
    """{row: (n_words, n_hit, items)}"""
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for item, text in bench:
        if item is None or text is None:
            continue
        w = word.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(str(item))
    out = []
    for text in docs:
        w = word.findall(lower(text or ""))
        hit, items = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                found = wins.get(tuple(w[k:k + size]))
                if found:
                    hit.update(range(k, k + size))
                    items |= found
        out.append((len(w), len(hit), sorted(items)))
    return out


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) <= n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def classes(nodes, linked):
    """{node: smallest reachable node}"""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_duplicates(docs, n=2, percent=80):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in docs}
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                links.append((a, b))
    comp = classes(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def repeated_lines(docs, edits, min_chars, near):
    """{(doc, line_no): (first doc, first line)} for repeated lines; ``near(a, b)`` decides on long ones."""
    places = {}
    for doc, text in docs:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            if line:
                places.setdefault(line, set()).add((doc, no))
    lines = sorted(places)
    counts = {x: Counter(x) for x in lines if len(x) >= min_chars}
    # an edit adds one character at most and takes one away at most
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(counts.items(), 2)
             if abs(len(a) - len(b)) <= edits and (x - y).total() <= edits and (y - x).total() <= edits and near(a, b)]
    comp = classes(lines, links)
    by_class = {}
    for line in lines:
        by_class.setdefault(comp[line], set()).update(places[line])
    return {p: min(own) for own in by_class.values() for p in own if p != min(own)}
