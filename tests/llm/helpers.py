"""Small documents that show every odd case, and brute-force versions."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def odd_documents():
    """(doc_id, text): nulls, empties, copies, near copies, shared passages, periodic and long texts."""
    base = words(120, 1)
    passage = " ".join(words(60, 2))
    near = list(base)
    near[50] = "changed"
    return [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, "short text"),
        (7, "aaaa" * 300),
        (8, "x " * 400),
        (9, f"before it {passage} and after"),
        (10, f"other words first\n\n{passage}\tthe end"),
        (11, "é" * 70 + " ñandú " * 40),
        (12, " ".join(words(3000, 3))),
        (13, " ".join(words(3000, 3)[500:900])),
        (14, " \t\n "),
        (15, passage + " " + passage),
    ]


def covered(tokens_by_doc, length):
    """doc -> mask of tokens covered by a window that starts earlier, by trying every window."""
    seen, out = set(), {}
    for i, t in tokens_by_doc:
        m = [False] * len(t)
        for j in range(len(t) - length + 1):
            w = bytes(t[j : j + length]) if isinstance(t, bytes) else tuple(t[j : j + length])
            if w in seen:
                m[j : j + length] = [True] * length
            else:
                seen.add(w)
        out[i] = m
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
