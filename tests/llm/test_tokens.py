"""Token ids, bit-packed files, packing: against the library and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from profilekit.llm import packed_ids, packing, tokens
from profilekit.llm.common import read

PATH = tokens.tokenizer_file()
ODD = ["", " ", "a  b", " a", "a ", "a\n\nb c", "it's we'll\tx y", " x y", "x　y z", "é ́ b", "a\x1c b",
       "<|endoftext|> a b<|endoftext|>", "a\n b", "日本 語 ", "|", "Ω x", "“x” y", "x", "word " * 5000, "x" * 20000]


def plain(text):
    return [*tokens.encoder(PATH).library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("memory", [1 << 21, 2])
def test_encoder_equals_library(memory):
    e = tokens.Encoder(PATH, memory=memory)
    ids, counts = e.encode([t.encode() for t in ODD])
    ends = np.cumsum(counts)
    for t, a, b in zip(ODD, ends - counts, ends):
        assert ids[a:b].tolist() == plain(t), t


def test_added_tokens_are_one_id():
    """As a fresh library object has it, with the file as given."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|>", "a b<|endoftext|>c d", "a <|endoftext|> b", "plain words here", "<|endoftext| >"]
    ids, _ = tokens.Encoder(PATH).encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in [*fresh.encode(t, add_special_tokens=False).ids, 0]]
    assert fresh.token_to_id("<|endoftext|>") in ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé .\n\t7!　", max_size=12), max_size=6))
def test_encoder_on_any_text(texts):
    ids, counts = tokens.encoder(PATH).encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in plain(t)]


@pytest.mark.parametrize("width", [1, 5, 8, 15, 16, 17, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(1).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (packed_ids.unpack(data, width, 1001) == ids).all()


def test_width():
    assert [packed_ids.width_for(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


def test_files_random_access(tmp_path):
    import pyarrow.fs as pafs

    rng, width = np.random.default_rng(2), 17
    rows = [rng.integers(0, 1 << width, n).astype(np.uint32) for n in (5, 1, 40_000, 3)]
    fs = pafs.LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "f")) as sink:
        w = packed_ids.Writer(sink, width)
        for k, r in enumerate(rows):
            w.add([k if k else None], np.array([len(r)]), r)
        w.close()
    whole = np.concatenate(rows)
    with fs.open_input_file(str(tmp_path / "f")) as source:
        r = packed_ids.Reader(source)
        assert r.docs[0] == packed_ids.NO_ID and r.counts.tolist() == [5, 1, 40_000, 3]
        for a, b in ((0, 1), (5, 6), (16_383, 16_385), (16_384, 32_768), (40_000, len(whole)), (7, 7)):
            assert (r.ids(a, b) == whole[a:b]).all()


def check_read_back(rows, got):
    got = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    at = 0
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(plain(t))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        match = next(x for x in texts[r.doc_id] if len(x) == r.n_tokens and crc(x) == r.ids_crc32)
        texts[r.doc_id].remove(match)
    assert not any(texts.values())


def test_packed_ids_query_rows(docs_of):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (99, None)]
    check_read_back(rows, packed_ids.encode_and_read(docs_of(rows), PATH).collect())
    assert packed_ids.encode_and_read(docs_of([]), PATH).count() == 0


def test_packed_ids_on_table(spark, sf):
    docs = read(spark, sf, "documents")
    check_read_back([tuple(r) for r in docs.select("doc_id", "text").collect()], packed_ids.encode_and_read(docs, PATH).collect())


def check_packing(rows, got, capacity):
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert 1 <= r.length <= capacity
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    for d, t in rows:
        ids, at = plain(t), 0
        for k, (piece, start, length, c) in enumerate(sorted(docs[d])):
            assert (piece, start) == (k, at) and crc(ids[at : at + length]) == c and (k == 0 or length == capacity)
            at += length
        assert at == len(ids)
    return len(seqs)


def test_pack_documents(docs_of, spark, sf):
    rows = list(enumerate(ODD)) + [(50, None)]
    check_packing(rows, packing.pack_documents(docs_of(rows), PATH).collect(), packing.CAPACITY)
    assert packing.pack_documents(docs_of([]), PATH).count() == 0
    docs = read(spark, sf, "documents")
    got = packing.pack_documents(docs, PATH).collect()
    n = check_packing([tuple(r) for r in docs.select("doc_id", "text").collect()], got, packing.CAPACITY)
    assert n <= 1.02 * packing.lower_bound(np.array([r.length for r in got]), packing.CAPACITY) + 1


def test_repeated_documents_are_packed_each(docs_of):
    got = packing.pack_documents(docs_of([(1, "same")] * 5 + [(None, "same")] * 2), PATH).collect()
    assert len(got) == 7 and len({(r.sequence_id, r.offset) for r in got}) == 7


def test_exchange_lowers_the_count(spark):
    """Groups of few pieces use more than their bound; exchange between groups fills the room."""
    cut = spark.range(400).selectExpr("id as doc_id", "20 + id * 7919 % 26 as length")
    alone = packing.pack(cut, 100, group_pieces=5, rounds=0)
    some = packing.pack(cut, 100, group_pieces=5, rounds=9)
    count = lambda df: df.select("sequence_id").distinct().count()
    assert packing.lower_bound(20 + np.arange(400) * 7919 % 26, 100) <= count(some) < count(alone)
    assert some.count() == 400


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_bound_and_fit_by_brute_force(lengths):
    """No packing beats the bound; best fit is a valid packing."""
    x = np.array(lengths, np.int64)
    bins, offsets, n = packing.best_fit_decreasing(x, 12)
    loads = np.bincount(bins, weights=x, minlength=1)
    assert (loads <= 12).all()

    def least(rest, open_, best):
        if len(open_) >= best:
            return best
        if not rest:
            return len(open_)
        for k in range(len(open_)):
            if open_[k] + rest[0] <= 12 and open_[k] not in open_[:k]:
                best = least(rest[1:], [*open_[:k], open_[k] + rest[0], *open_[k + 1 :]], best)
        return least(rest[1:], [*open_, rest[0]], best)

    best = least(sorted(lengths, reverse=True), [], len(lengths) + 1) if lengths else 0
    assert packing.lower_bound(x, 12) <= best <= n


def test_bound_values():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([4, 4, 4, 4, 4, 4]), 11) == 3
    assert packing.lower_bound(np.array([], np.int64), 10) == 0
