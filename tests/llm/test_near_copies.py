"""ProbMinHash estimates, classes against brute force, components."""

import random
import re

import numpy as np
import pytest

from profilekit.llm import near_copies as nc
from profilekit.llm.common import mix, read
from profilekit.llm.graph import components


def runs(text):
    w = re.sub(r"[\x20\x09-\x0d]+", " ", (text or "").lower()).strip(" ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [runs(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for r in s:
            where.setdefault(r, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for r in s for j in where[r] if j < k}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                parent[top(k)] = top(j)
    out = {}
    for k in range(len(rows)):
        out.setdefault(top(k), []).append(k)
    return out


def check(rows, got, allow=0):
    classes = brute_classes(rows)
    want = {}
    for members in classes.values():
        best = min((rows[k][0] is None, rows[k][0] or 0) for k in members)
        for k in members:
            want.setdefault(rows[k][0], []).append((None if best[0] else best[1], len(members)))
    assert len(got) == len(rows)
    wrong = 0
    for r in got:
        if (r.class_id, r.class_size) in want[r.doc_id]:
            want[r.doc_id].remove((r.class_id, r.class_size))
        else:
            wrong += 1
    assert wrong <= allow
    assert sum(r.kept for r in got) >= len(classes)
    if not allow:
        assert sum(r.kept for r in got) == len(classes) and all(r.doc_id == r.class_id for r in got if r.kept)


def text(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, base, share):
    words = base.split()
    for k in rng.sample(range(len(words)), int(len(words) * share)):
        words[k] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_of_edited_texts(docs_of):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        base = text(rng, rng.randrange(60, 400))
        rows += [(10 * k + j, edited(rng, base, share)) for j, share in enumerate((0, 0, 0.01, 0.02, 0.03, 0.2))]
    check(rows, nc.near_copies(docs_of(rows)).collect())


def test_large_group_of_near_copies(docs_of):
    """Most members are linked to the group's centre only, which is not its first row."""
    rng = random.Random(6)
    base = text(rng, 300)
    rows = [(k, edited(rng, base, 0.015)) for k in range(200)] + [(500, base)] + [(1000 + k, text(rng, 80)) for k in range(50)]
    got = nc.near_copies(docs_of(rows)).collect()
    check(rows, got)
    assert max(r.class_size for r in got) == 201


def test_pairs_that_differ_by_a_repeated_block(docs_of):
    """Sets that agree to 0.83, where one text holds a block of 40 words a hundred times."""
    rng = random.Random(7)
    rows = []
    for k in range(30):
        base, block = text(rng, 204, 10**6), text(rng, 40, 10**6)
        rows += [(2 * k, base), (2 * k + 1, " ".join([base, *[block] * 100]))]
    check(rows, nc.near_copies(docs_of(rows)).collect())


def test_edge_rows(docs_of):
    long = "word " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + "word"), (None, "one"), (9, "a b c d e"), (10, "a  b\nc d E"), (4, "one"), (11, "two one")]
    check(rows, nc.near_copies(docs_of(rows)).collect())
    assert nc.near_copies(docs_of([])).count() == 0


def test_keep_one_keeps_columns(docs_of):
    docs = docs_of([(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words that stand here alone"), (4, None), (5, None)])
    kept = nc.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]


def test_on_table(spark, sf):
    docs = read(spark, sf, "documents")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], nc.near_copies(docs).collect())


def test_estimate_is_probability_jaccard():
    rng = np.random.default_rng(0)
    h = mix(np.arange(60, dtype=np.uint64) + np.uint64(1))
    x, y = rng.uniform(0, 3, 60) * (rng.uniform(size=60) < 0.8), rng.uniform(0, 3, 60) * (rng.uniform(size=60) < 0.8)
    true = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(60)) for i in range(60) if x[i] and y[i])
    of = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    s = nc.signatures(of, np.concatenate([h[x > 0], h[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.03)


def test_signature_of_few_elements_is_full():
    s = nc.signatures(np.array([0, 2]), np.array([5, 9], np.uint64), np.array([1.0, 2.0]), 3, 64)
    assert (s[0] == 5).all() and (s[1] == 0).all() and (s[2] == 9).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 120)] + [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for size in (1, 30, 200):
        x, y = (np.unique(rng.choice(pool, size)) for _ in range(2))
        of = np.repeat([0, 1], [len(x), len(y)])
        a, b = nc.parity_bits(of, np.concatenate([x, y]), 3).reshape(3, nc.BITS)[:2]
        differ = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y)) and differ % 2 == len(np.setxor1d(x, y)) % 2
    assert not nc.parity_bits(of, np.concatenate([x, y]), 3).reshape(3, nc.BITS)[2].any()
