"""Plain, slow versions of the operators to hold them against."""

import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def classes(nodes, links):
    """node -> least node reachable."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def similar_documents(texts, k, num=80, den=100):
    """(sets, least id of each class) for texts by id."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    where = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            where[s].append(i)
    links = []
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s] if j > i)
        links += [(i, j) for j, n in shared.items() if den * n >= num * (len(sets[i]) + len(sets[j]) - n)]
    return sets, classes(sets, links)


def kept_words(texts, window):
    """id -> (all words, words that no repeated window covers)."""
    split = {i: words(t) for i, t in texts.items()}
    seen = Counter(tuple(w[s : s + window]) for w in split.values() for s in range(len(w) - window + 1))
    result = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        result[i] = (w, [x for n, x in enumerate(w) if n not in gone])
    return result


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def removed_lines(texts, edits, least):
    """id -> numbers of the lines that go."""
    places = [(i, n, line) for i in sorted(texts) for n, line in enumerate((texts[i] or "").split("\n")) if words(line)]
    lines = sorted({line for _, _, line in places})
    long = [x for x in lines if len(x) >= least]
    links = [
        (a, b) for n, a in enumerate(long) for b in long[n + 1 :] if abs(len(a) - len(b)) <= edits
        and sum((Counter(a) - Counter(b)).values()) <= edits and distance(a, b) <= edits
    ]
    of = classes(lines, links)
    first = {}
    for i, n, line in places:
        first.setdefault(of[line], (i, n))
    gone = defaultdict(set)
    for i, n, line in places:
        if first[of[line]] != (i, n):
            gone[i].add(n)
    return gone
