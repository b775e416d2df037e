"""Small tables and brute-force counterparts."""

from __future__ import annotations

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def documents(seed: int, n: int = 60):
    """(doc_id, text) with copies, near copies, shared passages, long repeats, null and empty texts."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghié") for _ in range(r.randint(1, 8))) for _ in range(400)]
    passage = " ".join(r.choice(pool) for _ in range(80))
    out = []
    for i in range(n):
        kind = r.random()
        text = " ".join(r.choice(pool) + r.choice(["", "", ".", ".\n"]) for _ in range(r.randint(1, 200)))
        if kind < 0.15 and out:
            text = r.choice(out)[1] or ""
        elif kind < 0.35 and out:
            ws = (r.choice(out)[1] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                ws[r.randrange(len(ws))] = r.choice(pool)
            text = " ".join(ws)
        elif kind < 0.5:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2:]
        elif kind < 0.55:
            text = text + (" " + text) * r.randint(1, 3)
        out.append((i * 2, text))
    return [*out, (1, None), (3, ""), (5, " \n\t "), (7, "x"), (9, "a b c d e f g h i j k l"), (11, "x")]


def full(rows):
    """Rows of the schema of documents."""
    return [(i, t, "en", ["b", "a", None, "c"][(i or 0) % 4], len(t or "")) for i, t in rows]


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def shingle_sets(rows, width=5):
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = frozenset(tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset()
    return out


def near_classes(rows, least=0.8):
    sets, links = shingle_sets(rows), []
    ids = sorted(sets)
    by_text = collections.defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    for same in by_text.values():
        links += [(a, same[0]) for a in same[1:]]
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
                links.append((a, b))
    return roots(ids, links)
