"""Grammar-based runs against a comparison at every distance."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilekit.llm import periodic_runs as pr
from profilekit.llm.queries import QUERIES


def hashes_of(ids):
    return pr.mix(np.asarray(ids, np.uint64) + np.uint64(7))


def by_definition(words):
    """Every longest stretch that repeats with its least period, from the definition; for short texts."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        for s in range(n):
            if s and s - 1 + q < n and words[s - 1] == words[s - 1 + q]:
                continue
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e > n or e - s < max(6, 4 * q):
                continue
            if not any(all(words[i] == words[i + p] for i in range(s, e - p)) for p in range(1, q)):
                out.add((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng, kind):
    if kind == "few words":
        return [rng.integers(0, 2, rng.integers(0, 60)) for _ in range(60)]
    if kind == "powers":
        return [np.resize(rng.integers(0, 5, rng.integers(1, 9)), rng.integers(0, 80)) for _ in range(60)]
    if kind == "nested":
        inner = np.concatenate([np.resize([1, 2], 10), [3]])
        return [np.concatenate([rng.integers(0, 9, 5), np.resize(inner, 55), rng.integers(0, 9, 7), np.full(9, 4)]) for _ in range(5)]
    base = rng.integers(0, 30, 70)  # copies, so that whole texts are shared symbols
    return [np.concatenate([base[: rng.integers(0, 70)], np.resize([5, 6, 7], rng.integers(0, 20)), base]) for _ in range(30)]


@pytest.mark.parametrize("kind", ["few words", "powers", "nested", "copies"])
def test_runs_of_many_texts_at_once(kind):
    rng = np.random.default_rng(len(kind))
    all_texts = texts(rng, kind)
    row = np.repeat(np.arange(len(all_texts)), [len(t) for t in all_texts])
    first = np.concatenate([[0], np.cumsum([len(t) for t in all_texts])])
    found = list(zip(*(x.tolist() for x in pr.text_runs(hashes_of(np.concatenate(all_texts)), row))))
    want = [(s + first[k], n, q) for k, t in enumerate(all_texts) for s, n, q in by_definition(t.tolist())]
    assert found == want and len(want) > 3


def test_plain_runs_equals_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        words = rng.integers(0, 2, rng.integers(0, 40))
        assert sorted(pr.plain_runs(hashes_of(words)), key=lambda r: (r[0], r[2])) == by_definition(words.tolist())


def test_colliding_sums_are_caught(monkeypatch):
    rng = np.random.default_rng(4)
    words = np.concatenate([rng.integers(0, 50, 40), np.resize([1, 2, 3], 30), rng.integers(0, 50, 40)])
    real = pr.Equal.__call__

    def lies(self, a, lag, n):
        return real(self, a, lag, n) | (n == 9)  # says that any nine words are alike

    monkeypatch.setattr(pr.Equal, "__call__", lies)
    row = np.zeros(len(words), np.int64)
    got = list(zip(*(x.tolist() for x in pr.text_runs(hashes_of(words), row))))
    assert got == by_definition(words.tolist())


def test_one_long_text_of_one_word_and_of_nested_periods():
    n = 300_000
    got = pr.text_runs(hashes_of(np.ones(n)), np.zeros(n, np.int64))
    assert [x.tolist() for x in got] == [[0], [n], [1]]
    words = np.resize(np.concatenate([np.resize([1, 2, 3], 200), [9]]), n)
    got = pr.text_runs(hashes_of(words), np.zeros(n, np.int64))
    assert (0, n, 201) in set(zip(*(x.tolist() for x in got))) and len(got[0]) == 1 + -(-n // 201)


def test_symbols_are_shared_between_copies():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 1000, 500)
    row = np.repeat(np.arange(40), 500)
    one, many = pr.Grammar(text, row[:500]), pr.Grammar(np.tile(text, 40), row)
    assert len(many.size) <= len(one.size) and len(many.symbols) == 40 * 499


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 9), (4, "a " * 9), (5, "x\ny\x0bx y\tx  y x y z"), (6, "a a a a a"), (7, "a a a a a a"), (8, "é b " * 6), (9, "no runs here at all")]


def test_results_of_small_tables(docs_of):
    rows = pr.find(docs_of(EDGES)).collect()
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.n_words, bytes(r.collapsed).decode()) for r in rows}
    assert len(rows) == len(EDGES)
    assert got[1] == got[2] == got[3] == ([], 0, "")
    assert got[4] == ([(0, 9, 1)], 9, "a")
    assert got[5] == ([(0, 8, 2)], 9, "x y z")
    assert got[6] == ([], 5, "a a a a a") and got[7] == ([(0, 6, 1)], 6, "a")
    assert got[8] == ([(0, 6, 1)], 6, "é b")
    assert pr.find(docs_of(EDGES).limit(0)).count() == 0


def test_greatest_run_is_compared_exactly(spark):
    runs = [[(5, 14, 2), (30, 21, 3), (60, 28, 4)], [(0, 8, 2), (9, 13, 3)], [(3, 8, 2), (3, 9, 2)], [], None]
    df = spark.createDataFrame([(r,) for r in runs], "runs array<struct<start:long,length:long,period:long>>")
    got = [r[0] and tuple(r[0]) for r in df.select(pr.greatest(F.col("runs"))).collect()]
    assert got == [(5, 14, 2), (9, 13, 3), (3, 9, 2), None, None]


def planted(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_registered_query_equals_a_plain_twin(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(docs)
    some = 0
    for r in rows:
        words = planted(r.doc_id, docs[r.doc_id])
        ids = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, int)
        runs = sorted(pr.plain_runs(ids), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        some += bool(runs)
    assert some > 5
