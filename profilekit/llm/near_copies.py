"""Near duplicates by ProbMinHash signatures of word shingles, banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_struct, lower_joined, materialize, mix, numbered, shingles, utf8, word_hashes
from .graph import components


@dataclass(frozen=True)
class Plan:
    """Two texts whose shingles agree to 0.8 meet in one of the 24 bands of 6 with a chance of 0.9993."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 6


#: Parity bits of a set of shingles, in 64-bit numbers.
BITS = 8


def weighted_shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and weight of the distinct shingles of all texts, in order. A shingle that
    occurs n times weighs 1 + ln n; a text with fewer words is one shingle, one without words has none."""
    data, begins = lower_joined(texts)
    starts, hashes = word_hashes(data)
    cut = np.searchsorted(starts, begins)
    of, out, weights = [], [], []
    for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(starts)])):
        if b > a:
            h, n = np.unique(shingles(hashes[a:b], words), return_counts=True)
            of.append(np.full(len(h), k))
            out.append(h)
            weights.append(1 + np.log(n))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return np.concatenate(of), np.concatenate(out), np.concatenate(weights)


def signatures(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash signatures (n documents, ``size`` components; 0 for those without elements).

    Every element has a Poisson process of arrivals with its weight as rate, each arrival falls on a random component,
    and a component keeps the element that arrived there first; both are drawn from the element's
    hash alone. An element is dropped as soon as its next arrival lies beyond the latest first arrival of its document. Two
    documents agree in a component with the probability Jaccard similarity of their weights.
    """
    first = np.full(n * size, np.inf)
    out = np.zeros(n * size, np.uint64)
    time = np.zeros(len(hashes))
    k = 0
    while len(hashes):
        k += 1
        with np.errstate(over="ignore"):
            draw = mix(hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) / 2.0**53)) / weights
        at = of * size + (mix(draw) % np.uint64(size)).astype(np.int64)
        sooner = np.flatnonzero(time < first[at])
        sooner = sooner[np.argsort(-time[sooner], kind="stable")]  # the earliest is written last
        first[at[sooner]] = time[sooner]
        out[at[sooner]] = hashes[sooner]
        latest = first.reshape(n, size).max(axis=1)
        go = time < latest[of]
        of, hashes, weights, time = of[go], hashes[go], weights[go], time[go]
    return out.reshape(n, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64) + np.zeros((len(signature), 1), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.astype(np.int64)


def sign(docs: DataFrame, plan: Plan) -> DataFrame:
    """row, doc_id, digest of the set of shingles, their number, keys of the bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            n = part.num_rows
            # links compare sets, so every distinct shingle weighs the same here
            of, hashes, _ = weighted_shingles(part.column("text").to_pylist(), plan.words)
            counts = np.bincount(of, minlength=n)
            keys = band_keys(signatures(of, hashes, np.ones(len(hashes)), n, plan.bands * plan.rows), plan.bands, plan.rows)
            ends = np.cumsum(counts)
            digests = [hashlib.blake2b(hashes[e - c : e].tobytes(), digest_size=16).digest() for c, e in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array([k.tolist() if c else [] for c, k in zip(counts, keys)], pa.list_(pa.int64()))],
                names=["row", "doc_id", "digest", "n", "keys"],
            )

    own = docs.select("row", F.col("doc_id").cast("long"), utf8().alias("text"))
    return own.mapInArrow(run, "row long, doc_id long, digest binary, n long, keys array<long>")


def parity_bits(of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """64 * BITS bits a document: how many of its shingles fall on each, modulo 2. Two sets that differ in d shingles differ in d bits at most."""
    at = of * (64 * BITS) + (mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.int64) % (64 * BITS)
    return np.packbits((np.bincount(at, minlength=n * 64 * BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """row, set: the sorted hashes of each document's shingles, bits: their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            of, hashes, _ = weighted_shingles(part.column("text").to_pylist(), words)
            cut = np.searchsorted(of, np.arange(part.num_rows + 1))
            sets = pa.array([hashes[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
            ends = pa.array(np.arange(part.num_rows + 1) * BITS, pa.int32())
            bits = pa.ListArray.from_arrays(ends, pa.array(parity_bits(of, hashes, part.num_rows)))
            yield pa.RecordBatch.from_arrays([part.column("row"), sets, bits], names=["row", "set", "bits"])

    return docs.select("row", utf8().alias("text")).mapInArrow(run, "row long, set binary, bits array<long>")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b, similarity of those pairs whose sets (row, set) have at least that Jaccard similarity."""
    kind = dict(sets.dtypes)["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                got[k] = both / max(1, len(x) + len(y) - both)
            keep = pa.array(got >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got)], names=["a", "b", "similarity"]).filter(keep)

    x, y = sets.select(F.col("row").alias("a"), F.col("set").alias("x")), sets.select(F.col("row").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def links(docs: DataFrame, signed: DataFrame, plan: Plan) -> DataFrame:
    """a, b, similarity: verified links between texts with different shingles, enough to connect all that are linked.

    In each bucket the text that meets the most others over all its buckets is the first to be compared with, so
    a large group of near copies takes about as many comparisons as it has members. Texts of one bucket that are not
    connected after that are all compared with each other, but for pairs whose lengths or parity bits show that they differ
    too much: these bound the similarity from above, so no link is lost.
    """
    texts = signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    at = texts.select("row", "n", F.explode("keys").alias("key"))
    many = at.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    at = materialize(at.join(many, "key"), "bands")
    met = at.groupBy("row").agg(F.sum("members").alias("met"))
    at = materialize(at.join(met, "row").select("key", "row", "n", "met"), "bands")
    needed = materialize(at.select("row").distinct(), "needed")  # as a table its size is known, so a small one is broadcast and no text is shuffled
    sets = materialize(shingle_sets(docs.join(needed, "row", "left_semi"), plan.words), "sets")
    first = at.groupBy("key").agg(F.max(F.struct("met", F.negative("row").alias("_o"), "n", "row")).alias("f")).select("key", F.col("f.row").alias("b"), F.col("f.n").alias("m"))
    near = F.least("n", "m") >= F.greatest("n", "m") * plan.similarity - 1e-9
    # sets as similar as that differ in so many shingles at most
    differ = reduce(add, [F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("other")[k])) for k in range(BITS)])
    alike = near & (differ <= (F.col("n") + F.col("m")) * ((1 - plan.similarity) / (1 + plan.similarity)) + 1e-6)
    pairs = materialize(at.join(first, "key").where(F.col("row") != F.col("b")).where(near).select(F.col("row").alias("a"), "b").distinct(), "pairs")
    sure = materialize(verify(pairs, sets, plan.similarity), "links")
    placed = at.join(components(sure).select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    # each text outside its bucket's largest part meets all others there: no pair lies within one part
    part = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = part.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.root").alias("top"))
    placed = materialize(placed.join(largest, "key").join(sets.select("row", "bits"), "row").select("key", "row", "n", "root", "top", "bits"), "open")
    x = placed.where("root != top").select("key", F.col("row").alias("a"), "n", F.col("root").alias("ra"), "bits")
    y = placed.select("key", F.col("row").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"), "top", F.col("bits").alias("other"))
    # of two texts outside the largest part, the smaller asks
    rest = x.join(y, "key").where("ra != rb and (rb = top or a < b)").where(alike).select("a", "b").distinct()
    rest = rest.join(pairs, ["a", "b"], "left_anti").join(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    return sure.unionByName(materialize(verify(materialize(rest, "pairs"), sets, plan.similarity), "links"))


def near_copies(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per document: row, doc_id, class_id, class_size, kept.

    Two documents are linked when their sets of runs of five words (lower case, white space ``[\\x20\\x09-\\x0D]``) have a Jaccard similarity of
    0.8 or more; a class is all that is connected. class_id is the class's smallest doc_id (null last), and
    the row with it stays (of rows that repeat it, the first). Texts with fewer words are one run;
    null, empty and blank texts have none and are classes of their own. Other columns are ignored. ``row`` numbers
    the rows. An empty table gives an empty one.
    """
    return _classes(numbered(docs.select("doc_id", "text")), plan)


def _classes(docs: DataFrame, plan: Plan) -> DataFrame:
    """``near_copies`` of a written table (row, doc_id, text)."""
    signed = materialize(sign(docs, plan), "signed")
    joined = components(links(docs, signed, plan)).select(F.col("node").alias("rep"), "root")
    reps = signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("rep"))
    # documents without words have a class of their own
    placed = signed.select("row", "doc_id", "n", "digest").where("n > 0").join(reps, "digest").join(joined, "rep", "left")
    placed = placed.select("row", "doc_id", F.coalesce("root", "rep").alias("class")).unionByName(signed.where("n = 0").select("row", "doc_id", F.col("row").alias("class")))
    placed = materialize(placed, "classes")
    best = placed.groupBy("class").agg(F.min(_by_id()).alias("best"), F.count("*").alias("class_size"))
    return placed.join(best, "class").select("row", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def _by_id() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def keep_one(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One document of each class, with all its columns."""
    own = in_struct(docs)
    kept = _classes(own.select("row", "own.doc_id", "own.text"), plan).where("kept").select("row")
    return own.join(kept, "row", "left_semi").select("own.*")
