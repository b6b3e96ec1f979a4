"""Nearest neighbours: recall against brute force, edge rows, split buckets."""

import numpy as np
import pytest

from profilekit.llm import neighbours as nn
from profilekit.llm.common import read

QUERY = "vec_id % 100 = 0"


def brute(rows, k=10):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in rows if j != i and len(v) == len(q))
            out[i] = d[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall(spark, size):
    table = read(spark, f"/root/testdata/{size}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    true, got = brute(rows), found(nn.search(table, QUERY))
    assert set(got) == set(true)
    hits = [len({v for _, v in got[q]} & {v for _, v in true[q]}) / len(true[q]) for q in true]
    assert np.mean(hits) >= 0.9
    by_id = dict(rows)
    for q, answers in got.items():
        assert answers == sorted(answers)
        for d, v in answers:
            assert d == pytest.approx(np.sqrt(((np.array(by_id[q], float) - np.array(by_id[v], float)) ** 2).sum()), abs=1e-12)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0, 2.0, 3.0]), (100, [1.0, 1.0]), (200, None), (300, [0.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = found(nn.search(table, QUERY))
    s = 2**0.5
    assert got == {0: [(0.0, 1), (1.0, 100), (pytest.approx(s), 2)], 100: [(1.0, 0), (1.0, 1), (1.0, 2)]}
    assert nn.search(table.limit(0), QUERY).count() == 0
    assert nn.search(table.where("vec_id = 100"), QUERY).count() == 0


def test_equal_vectors_and_ties(spark):
    """A large group of copies: the ten smallest ids but the query's own, at distance zero."""
    table = spark.range(3000).selectExpr("id as vec_id", "case when id % 3 = 0 then array(1f, 2f) else array(cast(id as float), 0f) end as embedding")
    got = found(nn.search(table, QUERY))
    assert [v for _, v in got[300]] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert [v for _, v in got[0]] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30]


def test_split_buckets_give_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = nn.Plan(tables=3, functions=2, probes=9, width=8.0)
    one = found(nn.search(table, QUERY, plan=wide))
    split = found(nn.search(table, QUERY, plan=nn.Plan(tables=3, functions=2, probes=9, width=8.0, group_rows=100)))
    assert one == split == {q: [(pytest.approx(d), v) for d, v in a] for q, a in brute(rows).items()}


