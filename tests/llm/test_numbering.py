"""Results do not depend on how later scans of the input are split."""

import random

import pytest

from profilekit import session
from profilekit.llm import line_copies, mixing, near_copies, passages

SPLIT = "spark.sql.files.maxPartitionBytes"


def found(x):
    return sorted(map(str, x.collect()))


@pytest.fixture(scope="module")
def docs(spark, docs_of, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for d in range(60):
        own = " ".join(word() for _ in range(20 + d))
        rows.append((d, f"{own}\n{passage}" if d % 3 == 0 else own if d % 3 == 1 else rows[-1][1], "ab"[d % 2]))
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs_of(rows).repartition(6, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("run", [near_copies.keep_one, line_copies.drop_matches, passages.repeated_passages, mixing.mixed_documents])
def test_scans_may_be_split_anew(spark, docs, monkeypatch, run):
    want, write, calls = found(run(docs)), session.materialize, []

    def split_anew(df, name, keep=False):
        out = write(df, name)
        calls.append(name)
        spark.conf.set(SPLIT, "4000")
        return out

    monkeypatch.setattr(session, "materialize", split_anew)
    try:
        assert found(run(docs)) == want and calls
    finally:
        spark.conf.unset(SPLIT)
