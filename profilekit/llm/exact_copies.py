"""Exact duplicates by compressed radix tries over length-and-content-hash partitions.

Every task inserts its own texts into a trie first, so that of a group of copies, however large, one
row per task is shuffled. The owners of the tasks are then dealt by length and content hash, sorted by them, and
inserted into a trie whose keys are length, hash and full text. Keys arrive in order: once a key
with a larger head arrives, all smaller subtrees are complete, and they are emitted and freed. The
trie therefore holds little more than one head's texts; Spark's sort spills the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, materialize, utf8

#: Bytes of text that a task's first trie holds at most; it is emptied, and a new one begun, beyond.
TRIE_BYTES = 64 << 20


class Node:
    """An edge label and what lies below it; where a key ends, the least value and whatever the caller gathers."""

    __slots__ = ("label", "below", "best", "size", "rows")

    def __init__(self, label: bytes, best=None):
        self.label, self.below, self.best, self.size, self.rows = label, {}, best, 0, []


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """Patricia trie from bytes to the least value seen for them."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, value):
        """Puts the smaller of ``value`` and what is there at ``key``; returns the key's node."""
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                node.below[key[at]] = new = Node(key[at:], value)
                self.held += len(key) - at
                return new
            n = _common(key[at:] if at else key, child.label)
            if n < len(child.label):
                fork = Node(child.label[:n])
                child.label = child.label[n:]
                fork.below[child.label[0]] = child
                node.below[key[at]] = fork
                child = fork
            node, at = child, at + n
        if node.best is None or value < node.best:
            node.best = value
        return node

    def take_before(self, key: bytes | None):
        """Frees all subtrees whose keys are below ``key`` and do not begin as it does; returns their terminal nodes."""
        out, stack = [], []
        node, at = self.root, 0
        while True:
            keep = key[at] if key is not None and at < len(key) else None
            for first in [f for f in node.below if keep is None or f < keep]:
                stack.append(node.below.pop(first))
            child = node.below.get(keep) if keep is not None else None
            if child is None:
                break
            if key[at : at + len(child.label)] != child.label:
                if child.label < key[at:]:
                    stack.append(node.below.pop(keep))
                break
            node, at = child, at + len(child.label)
        while stack:
            node = stack.pop()
            self.held -= len(node.label)
            if node.best is not None:
                out.append(node)
            stack.extend(node.below.values())
        return out


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after deleting the characters ``[\\x20\\x09-\\x0D]``; null counts as empty,
    and empty texts are copies of each other. The row with the most code points in its
    original text stays, then the one with the smallest doc_id (a null doc_id is last). Rows that
    repeat a doc_id are rows of their own in ``group_size``; of rows that are equal in all this, one stays. Other
    columns are ignored. An empty table gives an empty one.
    """
    schema = "row long, doc_id long, n_cp long, sha string, owner long, size long, n_bytes long, head binary, text binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, members = Trie(), []

        def flush() -> pa.RecordBatch:
            for m in members:
                m[4].size += 1
            rows = []
            for row, doc, n, sha, node, text in members:
                first = node.best[2] == row
                rows.append((row, doc, n, sha, node.best[2], node.size if first else None, len(text) if first else None, bytes.fromhex(sha[:16]) if first else None, text if first else None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        names = [c.split()[0] for c in schema.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            for row, doc, n, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_cp", "text"))):
                text = text.translate(None, SPACES)
                digest = hashlib.sha256(text)
                node = trie.insert(digest.digest()[:8] + text, (-n, (doc is None, doc or 0), row))
                members.append((row, doc, n, digest.hexdigest(), node, text if node.best[2] == row else b""))
                if trie.held > TRIE_BYTES or len(members) >= 50_000:
                    yield flush()
                    trie, members = Trie(), []
        if members:
            yield flush()

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, head = Trie(), None
        for batch in batches:
            out = []
            for row, doc, n, size, n_bytes, h, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_cp", "size", "n_bytes", "head", "text"))):
                now = n_bytes.to_bytes(8, "big") + h
                if now != head:
                    out += trie.take_before(now)
                    head = now
                node = trie.insert(now + text, (-n, (doc is None, doc or 0), row))
                node.rows.append(row)
                node.size += size
            yield _members(out)
        yield _members(trie.take_before(None))

    once = materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"), utf8().alias("text"))
        .mapInArrow(local, schema),
        "copies",
    )
    by_key = once.where(F.col("text").isNotNull()).select("row", "doc_id", "n_cp", "size", "n_bytes", "head", "text")
    merged = by_key.repartition("n_bytes", "head").sortWithinPartitions("n_bytes", "head").mapInArrow(owners, "owner long, keep_row long, keep_id long, group_size long")
    return (
        once.select("row", "doc_id", "sha", "owner")
        .join(merged, "owner")
        .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def _members(nodes: list[Node]) -> pa.RecordBatch:
    rows = [(row, n.best[2], None if n.best[1][0] else n.best[1][1], n.size) for n in nodes for row in n.rows]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["owner", "keep_row", "keep_id", "group_size"])
