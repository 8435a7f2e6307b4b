"""Plain forms of the corpus operators, to hold the Spark ones against."""

import re
from collections import Counter
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (id, text) or (id, text, source) as a documents table."""
    full = []
    for r in rows:
        i, t, s = (*r, "src")[:3] if len(r) == 2 else r
        full.append((i, t, "en", s, None if t is None else len(t)))
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return WORDS.findall(text or "")


def shingle_set(text, n=5):
    w = words(text)
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def near_classes(rows, threshold=0.8):
    """doc_id -> (class, rep, copies, links), by comparing all pairs of distinct shingle sets."""
    reps = {}
    for i, t in sorted(rows):
        s = shingle_set(t)
        if s:
            reps.setdefault(s, []).append(i)
    links = Counter()
    root = {s: s for s in reps}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(reps, 2):
        n = len(a & b)
        if n >= threshold * (len(a) + len(b) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            if x is not y:
                lo, hi = sorted((x, y), key=lambda s: reps[s][0])
                root[hi] = lo
    out = {}
    for s, ids in reps.items():
        for i in ids:
            out[i] = (reps[find(s)][0], ids[0], len(ids), links[s])
    return out


def repeated_words(text, n=5):
    w = words(text)
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
    return len(covered)


def prose(rng, n, vocabulary=400):
    """n pseudo-words."""
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
