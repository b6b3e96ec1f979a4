"""Product codes against plain Python, and Orchard's search against all distances."""

import hashlib
import math

import numpy as np
import pytest

from profilekit.llm import vector_codes as vc


@pytest.mark.parametrize("spread", [2, 40, 100_000])
def test_orchard_equals_all_distances(spread):
    rng = np.random.default_rng(spread)
    for entries in (1, 2, 5, 64):
        points = rng.integers(-spread, spread, (500, 4))
        book = rng.integers(-spread, spread, (entries, 4))
        book[entries // 2] = book[0]  # a repeated entry: the lower index is taken
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        best, distance = vc.orchard(points, book, vc.neighbour_lists(book))
        assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_orchard_leaves_far_entries_out(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(-100_000, 100_000, (64, 4))
    points = centres[rng.integers(0, 64, 300)] + rng.integers(-5, 5, (300, 4))
    looked, plain = [], np.ndarray.sum
    seen_zeros = np.zeros

    def zeros(shape, kind=float):
        out = seen_zeros(shape, kind)
        if kind is bool:
            looked.append(out)
        return out

    monkeypatch.setattr(vc.np, "zeros", zeros)
    vc.orchard(points, centres, vc.neighbour_lists(centres))
    assert plain(looked[0]) < 0.6 * looked[0].size


def twin(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*own[e])] if e in own else b for e, b in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {k: ("".join(f"{i:02x}" for _, i in f), e, by_label[label], sha) for (k, _, label), f, e in zip(kept, found, errors)}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")


def test_equals_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 32)], [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    rows += [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [float("-inf")] + [0.0] * 31, None)]
    rows += [(2000 + i, rows[0][1], 7) for i in range(40)]  # repeated vectors
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.report(table(spark, rows).repartition(5)).collect()}
    assert got == twin(rows)


def test_few_vectors_and_none(spark):
    rows = [(3, [0.5] * 16, None), (1, [-0.5] * 16, 2)]
    got = vc.report(table(spark, rows)).orderBy("vec_id").collect()
    assert [(r.code, r.error, r.label_error) for r in got] == [("00" * 16, 0, 0), ("01" * 16, 0, 0)]
    assert vc.report(table(spark, [(1, None, 1)])).count() == 0
    assert vc.report(table(spark, rows).limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_odd_lengths_end_in_zeros_and_large_values_are_limited(spark):
    rows = [(1, [1.0] * 17, 1), (2, [1.0] * 3, 1), (3, [], 1), (4, [3e38] * 17, 1)]
    books = vc.fit(table(spark, rows))
    assert books.entries.shape == (16, 4, 2)
    got = {r.vec_id: r.error for r in vc.encode(table(spark, rows), books, ["vec_id"]).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0}
    assert books.entries.max() == vc.LIMIT


def test_columns_are_kept_under_their_names(spark):
    rows = [(1, [1.0] * 16, 1), (2, [2.0] * 16, None)]
    df = table(spark, rows)
    got = vc.encode(df.withColumnRenamed("code", "_vector"), vc.fit(df), ["_vector", "vec_id"])
    assert got.columns == ["_vector", "vec_id", "code", "error"]
    assert {(r["_vector"], r.vec_id) for r in got.collect()} == {("x", 1), ("x", 2)}


def test_double_components(spark):
    df = spark.createDataFrame([(1, [0.1] * 16, 0), (2, [0.30000000000000004] * 16, 0)], "vec_id long, embedding array<double>, label int")
    assert vc.fit(df).entries[:, :, 0].tolist() == [[25, 76]] * 16
