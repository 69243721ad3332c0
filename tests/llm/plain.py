"""Plain versions of the operators, without Spark, to hold results against."""

import itertools
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    """docs: {id: text}. {id: (set size, component)}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for pair in itertools.combinations(ids, 2):
            shared[pair] += 1
    links = [p for p, n in shared.items() if 100 * n >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = smallest_reachable(docs, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}
