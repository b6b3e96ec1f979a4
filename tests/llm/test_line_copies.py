"""Line deduplication against brute force."""

import random
import re

import numpy as np
import pytest

from profilekit.llm import line_copies as lc
from profilekit.llm.common import read, word_hashes

LAST = (1 << 63) - 1


def words(line):
    return {w for w in re.split(r"[\x20\x09-\x0d]+", line.lower()) if w}


def brute(rows):
    """(doc, line): has an earlier match."""
    lines = []
    for k, (d, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        lines += [(d, j, words(x)) for j, x in enumerate((t or "").split("\n")) if words(x)]
    where, out = {}, []
    for i, (d, j, w) in enumerate(lines):
        near = {k for x in w for k in where.get(x, ())}
        gone = any(len(w & lines[k][2]) >= 0.8 * len(w | lines[k][2]) - 1e-12 for k in near)
        out.append((d, j, not gone))
        for x in w:
            where.setdefault(x, []).append(i)
    return out


def got(docs, **plan):
    return [(r.doc_id, r.line, r.kept) for r in lc.report(lc.line_matches(docs, lc.Plan(**plan))).collect()]


def test_edited_lines(docs_of):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    rows = []
    for d in range(120):
        lines = []
        for b in rng.sample(base, 4):
            x = b.split()
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = f"w{rng.randrange(300)}"
            lines.append(" ".join(x))
        rows.append((d, "\n".join(lines)))
    for bits in (24, 2):  # results do not depend on the number of buckets
        assert sorted(got(docs_of(rows), rarity_bits=bits)) == sorted(brute(rows))


def test_edge_rows(docs_of):
    rows = [(5, "A b c\n\n \t\na B c d e"), (4, "e d c b a"), (3, None), (2, ""), (1, "one\r\nONE"), (7, "one"), (None, "one\nnew line"), (8, "x " * 50_000 + "\nz"), (9, "z z\n" * 500), (5, "again here")]
    assert sorted(map(str, got(docs_of(rows)))) == sorted(map(str, brute(rows)))
    assert lc.line_matches(docs_of([])).count() == 0


def test_matches_are_true(docs_of, spark, sf):
    docs = read(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    report = lc.report(lc.line_matches(docs)).collect()
    assert sorted((r.doc_id, r.line, r.kept) for r in report) == sorted(brute(rows))
    text = dict(rows)
    for r in report:
        if not r.kept:
            assert (r.match_doc_id, r.match_line) < (r.doc_id, r.line)
            a, b = (words(text[d].split("\n")[k]) for d, k in ((r.doc_id, r.line), (r.match_doc_id, r.match_line)))
            assert r.similarity == pytest.approx(len(a & b) / len(a | b)) and r.similarity >= 0.8 - 1e-12


def test_common_line_and_group_of_near_copies(docs_of):
    rng = random.Random(4)
    base = [f"v{k}" for k in range(40)]
    rows = [(k, "the common line\n" + " ".join([*base[:38], f"u{rng.randrange(10**6)}", f"t{rng.randrange(10**6)}"])) for k in range(400)]
    assert sorted(got(docs_of(rows))) == sorted(brute(rows))


def test_all_links_of_near_copies(docs_of):
    """Every line's earliest match, number of links and class, by brute force."""
    rng = random.Random(5)
    base = [[f"v{g}_{k}" for k in range(20)] for g in range(4)]
    rows = []
    for k in range(60):
        x = list(base[k % 4])
        for _ in range(rng.randrange(4)):
            x[rng.randrange(20)] = f"u{rng.randrange(30)}"
        rows.append((k, " ".join(x)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    sets = [words(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12] for i in range(len(rows))]
    root = list(range(len(rows)))
    while (new := [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]) != root:
        root = new
    report = {r.doc_id: r for r in lc.report(lc.line_matches(docs_of(rows))).collect()}
    assert len(report) == len(rows) and max(map(len, near)) > 5
    for i, (d, _) in enumerate(rows):
        assert report[d].links == len(near[i]) and report[d].class_doc_id == rows[root[i]][0]
        equal = [j for j in near[i] if j < i and sets[j] == sets[i]]
        earlier = [j for j in near[i] if j < i]
        assert report[d].match_doc_id == (rows[equal[0]][0] if equal else rows[earlier[0]][0] if earlier else None)


def near_group(n):
    rng = random.Random(6)
    base = [f"v{k}" for k in range(30)]
    return [(k, " ".join([*base, f"u{k}", f"t{rng.randrange(9)}"])) for k in range(n)]


def test_links_written_grow_with_the_group(docs_of, spark):
    """A group of near-equal lines, all of which match each other: pairs written to connect it are no more than a few for each line."""
    rows = near_group(300)
    docs = lc.ordered(lc.numbered(docs_of(rows).select("doc_id", "text")))
    lines = lc.materialize(lc.signed_lines(docs, lc.Plan()), "lines")
    *_, links = lc._linked(docs, lines, lc.Plan())
    assert links.count() <= 4 * len(rows)
    assert [r.links for r in lc.report(lc.line_matches(docs_of(rows))).collect()] == [299] * 300


def test_blocks_of_a_group(docs_of):
    """Links are counted once each, whatever the size of the blocks."""
    rows = near_group(50) + [(100 + k, " ".join(f"x{j}" for j in range(k, k + 20))) for k in range(40)] + near_group(5)
    whole, cut = (sorted(map(str, lc.report(lc.line_matches(docs_of(rows), plan)).collect())) for plan in (lc.Plan(), lc.Plan(block=8, slices=1)))
    assert whole == cut


def test_words_that_agree_in_the_joined_bits(docs_of):
    """A line whose words collide is not a copy of itself."""
    many = [f"w{k}" for k in range(300_000)]
    _, hashes = word_hashes(np.frombuffer(" ".join(many).encode(), np.uint8))
    order = np.argsort(hashes)
    k = np.flatnonzero(np.diff(hashes[order] >> np.uint64(32)) == 0)[0]
    a, b = many[order[k]], many[order[k + 1]]
    common = [f"c{j}" for j in range(8)]
    rows = [(1, " ".join([a, b, *common])), (2, f"{a} y"), (3, f"{b} z")] + [(10 * j + i, f"{c} x{i}{j}") for i in range(4) for j, c in enumerate(common, 1)]
    assert sorted(got(docs_of(rows))) == sorted(brute(rows))


def test_drop_matches(docs_of):
    docs = docs_of([(1, "alpha beta\nkeep me"), (2, "alpha beta\n\nother thing"), (3, "beta alpha"), (4, None), (5, "\n"), (6, "last")])
    out = lc.drop_matches(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("alpha beta\nkeep me", 18), 2: ("\nother thing", 12), 4: (None, 0), 5: ("\n", 1), 6: ("last", 4)}
