"""Plain versions of the corpus operators, for small inputs."""

import collections
import re

WORD = r"[^\x20\x09-\x0D]+"


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_sets(rows, width):
    out = {}
    for i, text in rows:
        words = re.findall(WORD, lowered(text))
        out[i] = frozenset(tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))) if words else frozenset()
    return out


def jaccard_components(rows, width, percent):
    """doc_id -> (set size, smallest linked id)."""
    sets = shingle_sets(rows, width)
    holders, parent = collections.defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for k in s:
            holders[k].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for k in s for j in holders[k] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}, by giving out the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped.update(above)
