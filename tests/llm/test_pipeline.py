"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from profilekit.llm import cotraining, mixing
from profilekit.llm.common import read
from profilekit.session import materialize
from tests.llm.test_exact_and_mixing import brute_targets
from tests.llm.test_line_copies import brute as brute_lines
from tests.llm.test_near_copies import brute_classes, runs
from tests.llm.test_tokens import plain


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = read(spark, sf, "documents")
    out = [docs]
    for name, stage in cp.STAGES[:-1]:
        out.append(materialize(stage(spark, out[-1], sf), name))
    return [*out, cp.STAGES[-1][1](spark, out[-1], sf)]


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(stages, spark, sf):
    kept = {r.doc_id for r in cotraining.classify(stages[0], read(spark, sf, "labels")).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept


def test_lines(stages):
    before, gone, left = rows(stages[1]), defaultdict(set), Counter()
    for d, line, kept in brute_lines(before):
        left[d] += kept
        if not kept:
            gone[d].add(line)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in before if left[d] or not gone[d]}
    assert dict(rows(stages[2])) == want


def test_near_duplicates(stages):
    before = rows(stages[2])
    want = set()
    for members in brute_classes(before).values():
        if runs(before[members[0]][1]):
            want.add(min(before[k][0] for k in members))
        else:
            want |= {before[k][0] for k in members}
    assert {d for d, _ in rows(stages[3])} == want


def test_mix(stages):
    words = lambda t: len(t.split())
    before = {r.doc_id: r for r in stages[3].collect()}
    sizes, taken, got = defaultdict(int), defaultdict(int), Counter()
    for r in before.values():
        sizes[r.source] += words(r.text)
    for r in stages[4].collect():
        got[r.doc_id] += words(r.text)
        taken[r.source] += words(r.text)
        assert r.text == before[r.doc_id].text or not Counter(r.text.split()) - Counter(before[r.doc_id].text.split())
        assert r.n_chars == len(r.text)
    assert all(n <= 2 * words(before[d].text) for d, n in got.items())
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1.5 * mixing.BLOCK_WORDS + 0.01 * want[s] for s in sizes)


def test_pack(stages):
    got = stages[5].collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    texts = defaultdict(list)
    for d, t in rows(stages[4]):
        texts[d].append(len(plain(t)))
    lengths = defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
    assert lengths == {d: sum(n) for d, n in texts.items()}


def test_run_and_empty(spark, sf, stages, docs_of, tmp_path):
    assert cp.run(spark, sf).count() == stages[5].count()
    read(spark, sf, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, sf, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
