"""Plain definitions the operators are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, least=0.8):
    """doc position -> smallest position of its class, over all pairs of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b) / len(a | b) if a | b else 1.0
            if same >= least:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]
