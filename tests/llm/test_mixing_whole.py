"""The whole result of the source mix against a plain version: one seat at a time, one token at a time."""

import hashlib
import math
import random
from fractions import Fraction

import pytest
import xxhash

from cohortal.llm import mixing as MX
from tests.llm.helpers import documents, prose, words


def spark_hash(text):
    """xxhash64 of a string as Spark has it (null: the seed)."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def plain_targets(sizes, weights, most):
    """Shares by weight; while one exceeds its bound, it gets its bound and the others share the rest."""
    left, target, free = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = Fraction(most * sizes[i])
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


def plain_seats(votes, seats, caps):
    given = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if given[i] < caps[i] and votes[i] > 0]
        if not open_:
            break
        given[max(open_, key=lambda i: (Fraction(votes[i]) / (2 * given[i] + 1), -i))] += 1
    return given


def plain_mix(rows, block=16, per_shard=200, most=3, weights=(5, 2, 1)):
    """(id, size, source size, target, taken) of all rows."""
    docs = [(i, len(words(t)), s, hashlib.md5(f"0|{'' if i is None else i}|{spark_hash(t)}".encode()).hexdigest()) for i, t, s in rows]
    names = sorted({d[2] for d in docs if d[2] is not None}) + ([None] if any(d[2] is None for d in docs) else [])
    sizes = [sum(d[1] for d in docs if d[2] == s) for s in names]
    target = plain_targets(sizes, [weights[k % len(weights)] for k in range(len(names))], most)
    caps = [math.ceil(most * n / block) for n in sizes]
    seats = plain_seats(target, round(float(sum(target)) / block), caps)
    shards = max(1, math.ceil(len(docs) / per_shard))
    out = []
    for s, n, t, q in zip(names, sizes, target, seats, strict=True):
        parts = [[d for d in docs if d[2] == s and int(d[3][:8], 16) % shards == k] for k in range(shards)]
        parts = [p for p in parts if p]
        cells = [sum(d[1] for d in p) for p in parts]
        for p, quota in zip(parts, plain_seats(cells, q, [math.ceil(most * c / block) for c in cells]), strict=True):
            p.sort(key=lambda d: (d[3], d[0] is not None, d[0] or 0, d[1]))
            line = [k for k, d in enumerate(p) for _ in range(d[1])] * most
            blocks = [line[at : at + block] for at in range(0, len(line), block)][:quota]
            taken = [sum(b.count(k) for b in blocks) for k in range(len(p))]
            out += [(d[0], d[1], n, float(t), got) for d, got in zip(p, taken, strict=True)]
    return out


@pytest.mark.parametrize(("n", "per_shard", "seed"), [(60, 200, 1), (90, 7, 2), (45, 3, 3), (12, 5, 4)])
def test_mix_equals_the_plain_one(spark, n, per_shard, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "dd", None])
        rows.append((k if k % 11 else 3, None if k % 17 == 5 else "" if k % 17 == 6 else prose(rng, rng.randrange(1, 60)), source))
    rows += rows[:3]
    got = MX.mix_documents(documents(spark, rows), docs_per_shard=per_shard).collect()
    key = lambda r: (str(r[0]), *r[1:])
    want = sorted(plain_mix(rows, per_shard=per_shard), key=key)
    have = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=key)
    assert [(h[0], h[1], h[2], h[4]) for h in have] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert [h[3] for h in have] == pytest.approx([w[3] for w in want])
    assert sum(h[4] for h in have) > 0
