"""Plain Python versions that the operators are held against."""

import re
from collections import Counter, defaultdict


def shingle_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_components(rows, percent=85):
    """doc_id -> (set size, least doc_id reachable); exact, by prefix filtering over rare shingles."""
    sets = {d: frozenset(shingle_set(t)) for d, t in rows}
    classes = defaultdict(list)
    for d, s in sets.items():
        if s:
            classes[s].append(d)
    df = Counter(x for s in classes for x in s)
    parent = {s: s for s in classes}

    def find(s):
        while parent[s] is not s:
            parent[s] = s = parent[parent[s]]
        return s

    index = defaultdict(list)
    for s in sorted(classes, key=len):
        order = sorted(s, key=lambda x: (df[x], x))
        prefix = order[: len(s) - (percent * len(s) + 99) // 100 + 1]
        seen = set()
        for x in prefix:
            for o in index[x]:
                if id(o) in seen:
                    continue
                seen.add(id(o))
                if find(o) is not find(s) and 100 * len(o & s) >= percent * len(o | s):
                    parent[find(o)] = find(s)
            index[x].append(s)
    least = {}
    for s, ds in classes.items():
        least[find(s)] = min(least.get(find(s), min(ds)), min(ds))
    return {d: (len(s), least[find(s)] if s else d) for d, s in sets.items()}
