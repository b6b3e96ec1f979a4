"""Exact copies and source mixing on edge rows and against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest

from profilekit.llm import exact_copies as ec
from profilekit.llm import mixing
from profilekit.llm.common import read


def brute_copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0d]", "", t)].append((-len(t), d is None, d or 0))
    out = []
    for x, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for k, m in enumerate(sorted(members)):
            out.append((None if m[1] else m[2], keep, len(members), k == 0, hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (8, "ab c"), (9, "a b"),
        (10, "é" * 3), (11, "é é é"), (12, "x" * 100_000), (13, "x" * 99_999 + " x"), (14, "x" * 99_999 + "y"), (None, "ab"), (1, "a b"), (15, "a\xa0b")]


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_copies(docs_of, limit, monkeypatch):
    monkeypatch.setattr(ec, "TRIE_BYTES", limit)
    got = sorted((tuple(r) for r in ec.exact_copies(docs_of(ROWS)).collect()), key=str)
    assert got == brute_copies(ROWS)


def test_copies_empty_and_table(docs_of, spark, sf):
    assert ec.exact_copies(docs_of([])).count() == 0
    docs = read(spark, sf, "documents")
    got = sorted((tuple(r) for r in ec.exact_copies(docs).collect()), key=str)
    assert got == brute_copies([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_large_group_of_copies(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('t', id) end as text")
    got = ec.exact_copies(docs).where("group_size > 1").collect()
    assert len(got) == 1667 and {r.keep_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_trie_frees_complete_subtrees():
    t = ec.Trie()
    for k in (b"aa1", b"aa2", b"ab", b"ba", b"bb"):
        t.insert(k, (k,))
    assert sorted(n.best for n in t.take_before(b"ab")) == [(b"aa1",), (b"aa2",)]
    assert sorted(n.best for n in t.take_before(b"ba")) == [(b"ab",)]
    t.insert(b"ba", (b"a",))
    assert sorted(n.best for n in t.take_before(None)) == [(b"a",), (b"bb",)]
    assert t.held == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    """Limits met one after another until none is above its own."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if w[s] * level >= 2 * sizes[s]}
        if not above:
            return target | {s: w[s] * level for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def check_mix(rows, got, block):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    source = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    assert sorted(str((d, words(t))) for d, t, _ in rows) == sorted(str((r.doc_id, r.size)) for r in got)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 * block + 0.01 * want[s]


def test_mix_edges(docs_of):
    rows = [(k, "w " * (k * 7 % 90), s) for k, s in enumerate(["a", "b", None, "c", "é", "", "a", "a"] * 30)]
    rows += [(1000, None, "a"), (1001, "", "z"), (1002, " \t\n", "z"), (1003, "one", "y"), (1004, "word " * 30_000, "x")]
    check_mix(rows, mixing.mix(docs_of(rows)).collect(), mixing.BLOCK_WORDS)


def test_mix_many_shards_and_reruns(docs_of):
    rows = [(k, "w " * (k * 37 % 400), f"s{k % 7}") for k in range(1500)]
    run = lambda n: sorted(map(str, mixing.mix(docs_of(rows).repartition(n), shard_blocks=300).collect()))
    first = run(3)
    assert first == run(5)
    check_mix(rows, mixing.mix(docs_of(rows), shard_blocks=300).collect(), 64 * 6)


def test_mix_empty(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    got = mixing.mix(docs_of([(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_mix_repeated_rows(docs_of):
    got = mixing.mix(docs_of([(1, "a b c", "s")] * 4 + [(None, "a b", None)] * 2)).collect()
    assert len(got) == 6 and all(r.taken <= 2 * r.size for r in got)


def test_mix_on_table(spark, sf):
    docs = read(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    check_mix(rows, mixing.mix(docs).collect(), mixing.BLOCK_WORDS)


def test_quotas_by_hand(spark):
    """Votes 53, 24, 23 for seven seats: highest quotients give 3, 2, 2."""
    parts = spark.createDataFrame([(0, "a", 53.0 * 7), (1, "b", 24.0 * 7), (2, "c", 23.0 * 7)], "turn long, source string, votes double")
    got = {r.source: r.quota for r in mixing.quotas(parts, 100).collect()}
    assert got == {"a": 3, "b": 2, "c": 2}


def highest(votes, block):
    """Seats to the highest quotients, one after the other; equal ones by turn."""
    import heapq

    seats = [0] * len(votes)
    line = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(line)
    for _ in range(int(sum(votes) / block + 0.5)):
        _, i = heapq.heappop(line)
        seats[i] += 1
        heapq.heappush(line, (-votes[i] / (2 * seats[i] + 1), i))
    return seats


@pytest.mark.parametrize("votes", [
    [1_000_000.0] + [20.0] * 2_000, [640.0] * 300, [64.0 * k for k in range(1, 200)], [30.0] * 9, [5.0], [0.0, 0.0], [], [0.0, 1e6, 3.0, 64.0],
])
def test_quotas_equal_the_highest_quotients(spark, votes):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "turn long, votes double")
    got = {r.turn: r.quota for r in mixing.quotas(df, 64).collect()}
    assert [got[i] for i in range(len(votes))] == highest(votes, 64)


@pytest.mark.parametrize("shard_blocks", [100_000, 12])
def test_thin_sources_get_their_target(docs_of, shard_blocks):
    """Three hundred equal sources of 800 words, and one large one: each within about a block of its target."""
    rows = [(k, "w " * 40, f"s{k % 300:03d}") for k in range(6_000)] + [(10_000 + k, "w " * 500, "large") for k in range(400)]
    got = mixing.mix(docs_of(rows), shard_blocks=shard_blocks).collect()
    source = {d: s for d, _, s in rows}
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]], size[source[r.doc_id]] = r.target, r.source_size
    for s in target:
        shards = size[s] // (64 * shard_blocks) + 1
        assert abs(taken[s] - target[s]) <= 64 * (1 + shards / 2) , s
    assert abs(sum(taken.values()) - sum(target.values())) < 0.01 * sum(target.values())


def test_mixed_documents_keep_columns_of_any_name(spark):
    rows = [(k, "alpha beta " * (k % 50 + 1), "s", 777 + k, "own", -1.5, k % 3) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, own string, `copy` double, _row int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert all((r["row"], r.own, r["copy"], r._row) == (777 + r.doc_id, "own", -1.5, r.doc_id % 3) for r in got.collect())
