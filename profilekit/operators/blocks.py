"""Best-matching pairs between many documents and many queries, without materialising all pairs.

Scores are computed over bounded blocks inside the tasks and only pairs above the limit and above the ``n`` best
so far leave a block; a task's table leaves at most ``n`` per query. Vectors are dense (``v array``) or sparse (``t array<int>`` term numbers with
``w array<double>`` weights).

The side that fits ``broadcast_bytes`` is sent to all tasks once and the other side is not shuffled. When
neither fits, the documents are sent in pieces that do, which a task holds one at a time; only beyond ``PIECES`` of them both
sides are cut into blocks and every pair of blocks is scored in a task of its own, which shuffles each side as often as the other has blocks. All
ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_per_key

BROADCAST_BYTES = 64 << 20
BLOCK_CELLS = 4_000_000
DOCS_PER_BLOCK = 50_000
QUERIES_PER_BLOCK = 50_000
QUERY_CHUNK = 1024
# documents go to the tasks in so many pieces at most; a task meets all pieces with so many queries at once
PIECES, SLAB_ROWS = 64, 16_384
SPREAD_ROWS = 1_000_000
# pairs whose exact product is computed at once
EXACT_PAIRS = 1 << 16
FIRST_DOCS = 256
# equal documents must tie exactly, whatever the order of the additions
SIM_DIGITS = 9


def dense_rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Equal-length lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = len(column)
    return flat.reshape(rows, -1 if rows and width is None else (width or 0))


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table.column(name).to_pylist())


def _flat(table: pa.Table):
    terms, weights = table.column("t").combine_chunks(), table.column("w").combine_chunks()
    lengths = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat_terms, flat_weights = terms.flatten(), weights.flatten()
    return flat_terms.to_numpy(zero_copy_only=False), flat_weights.to_numpy(zero_copy_only=False), lengths


def _dense_pairs(queries: pa.Table, docs: pa.Table, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, queries and scores of all pairs with a score of ``floor`` of the query or more; ``floor`` may rise from block to block.

    Products of single precision, lowered by the largest error they can have, tell which pairs can reach the floor;
    only those are computed in double precision.
    """
    asked, known = dense_rows(queries.column("v")), docs.column("v").combine_chunks()
    most, longest, at = max(1, BLOCK_CELLS // max(1, len(asked))), _longest(asked), 0
    while at < docs.num_rows:
        # blocks grow with the documents seen, so that the floor has risen before much is compared
        part = dense_rows(known.slice(at, min(most, max(FIRST_DOCS, at))), asked.shape[1])
        size = longest * _longest(part)
        kind, unit = (np.float32, 2.0**-23) if size < 1e30 else (np.float64, 2.0**-52)
        sims = asked.astype(kind) @ part.astype(kind).T
        # rounded down, so that no pair is lost to the narrower type
        limit = floor - 10.0**-SIM_DIGITS - (asked.shape[1] + 8) * unit * size
        near = np.flatnonzero(sims >= np.nextafter(limit.astype(kind), kind(-np.inf))[:, None])
        for some in range(0, len(near), EXACT_PAIRS):
            row, col = np.divmod(near[some : some + EXACT_PAIRS], len(part))
            yield at + col, row, np.einsum("ij,ij->i", asked[row], part[col])
        at += len(part)


def _longest(vectors: np.ndarray) -> float:
    """The greatest length; without bound where a component is not finite."""
    norm = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)))
    return norm if np.isfinite(norm) else np.inf


class _Postings:
    """A table's sparse documents in blocks, the entries of each block by term, then document."""

    def __init__(self, docs: pa.Table):
        terms, weights, lengths = _flat(docs)
        rows, ends = np.repeat(np.arange(docs.num_rows), lengths), np.concatenate([[0], np.cumsum(lengths)])
        self.blocks = []
        most, at = max(1, BLOCK_CELLS // QUERY_CHUNK), 0
        while at < docs.num_rows:
            # blocks grow with the documents seen, so that the floor has risen before much is sorted
            to = min(at + min(most, max(FIRST_DOCS, at)), docs.num_rows)
            own = slice(ends[at], ends[to])
            order = np.argsort(terms[own], kind="stable")
            self.blocks.append((at, to - at, terms[own][order], rows[own][order] - at, weights[own][order]))
            at = to


def _sparse_pairs(queries: pa.Table, known: _Postings, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_dense_pairs``. A query meets the entries of its own terms only; products are added up by rising term."""
    q_terms, q_weights, q_lengths = _flat(queries)
    ends = np.concatenate([[0], np.cumsum(q_lengths)])
    q_rows = np.repeat(np.arange(queries.num_rows), q_lengths)
    for at, size, terms, places, weights in known.blocks:
        low = np.searchsorted(terms, q_terms)
        n = np.searchsorted(terms, q_terms, side="right") - low
        if not n.any():
            continue
        done = np.concatenate([[0], np.cumsum(n)])[ends]  # products of the queries before each one
        # a limit that pairs without a common term reach: all documents with a term of the chunk count
        every = np.unique(places[np.isin(terms, q_terms)]) if floor.min() <= 10.0**-SIM_DIGITS else None
        first = 0
        while first < queries.num_rows:
            # as many queries as have so many products, one at least
            last = max(first + 1, int(np.searchsorted(done, done[first] + BLOCK_CELLS, side="right")) - 1)
            some = n[ends[first] : ends[last]]
            of = np.repeat(np.arange(ends[first], ends[last]), some)
            entry = np.arange(len(of)) + np.repeat(low[ends[first] : ends[last]] - (np.cumsum(some) - some), some)
            cell = (q_rows[of] - first) * size + places[entry]
            value = q_weights[of] * weights[entry]
            if every is None and len(cell) * 16 < (last - first) * size:
                cells, cell = np.unique(cell, return_inverse=True)
                sims = np.bincount(cell, value, len(cells))
            else:
                cells, sims = None, np.bincount(cell, value, (last - first) * size)
                if every is not None:
                    cells = (np.arange(last - first)[:, None] * size + every).ravel()
                    sims = sims[cells]
            row = (np.arange(len(sims)) if cells is None else cells) // size
            near = np.flatnonzero(sims >= (floor - 10.0**-SIM_DIGITS)[first + row])
            yield at + (near if cells is None else cells[near]) % size, first + row[near], sims[near]
            first = last


def _best_in(queries: pa.Table, docs: pa.Table, min_sim: float, n: int, postings: _Postings | None = None) -> Iterator[pa.RecordBatch]:
    """Per query its ``n`` best documents, by falling similarity, then document id. ``postings``: those of ``docs``, if sparse and known."""
    return _best_of(queries, [lambda: (docs, postings)], min_sim, n)


def _best_of(queries: pa.Table, pieces: list[Callable[[], tuple[pa.Table, _Postings | None]]], min_sim: float, n: int) -> Iterator[pa.RecordBatch]:
    """As ``_best_in``, with documents in pieces that are got one after the other."""
    if not queries.num_rows:
        return
    chunks = [queries.slice(at, QUERY_CHUNK) for at in range(0, queries.num_rows, QUERY_CHUNK)]
    floors = [np.full(chunk.num_rows, float(min_sim)) for chunk in chunks]
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(chunks)  # document ids, queries, scores
    for piece in pieces:
        docs, postings = piece()
        if not docs.num_rows:
            continue
        dense = "v" in queries.column_names
        pairs, known, doc_ids = _dense_pairs if dense else _sparse_pairs, docs if dense else postings or _Postings(docs), _ids(docs, "d")
        for i, chunk in enumerate(chunks):
            floor = floors[i]
            for found in pairs(chunk, known, floor):
                values = np.round(found[2], SIM_DIGITS)
                enough = values >= floor[found[1]]
                if not enough.any():
                    continue
                new = doc_ids[found[0][enough]], found[1][enough], values[enough]
                ids, cols, values = (np.concatenate(x) for x in zip(best[i], new)) if best[i] else new
                order = np.lexsort((ids, -values, cols))
                ids, cols, values = ids[order], cols[order], values[order]
                first = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
                rank = np.arange(len(cols)) - np.repeat(first, np.diff(np.r_[first, len(cols)]))
                floor[cols[rank == n - 1]] = values[rank == n - 1]  # later ones may tie with the last of the best
                best[i] = tuple(x[rank < n] for x in (ids, cols, values))
    for chunk, held in zip(chunks, best):
        if held:
            yield pa.RecordBatch.from_arrays([_column(_ids(chunk, "q")[held[1]]), _column(held[0]), pa.array(held[2])], names=["q", "d", "sim"])


def _column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids.astype(np.int64)) if ids.dtype.kind in "iu" else pa.array(ids.tolist(), type=pa.string())


def best_pairs(
    queries: DataFrame, docs: DataFrame, min_sim: float, n: int, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``q, d, sim``: the ``n`` best documents per query with ``sim >= min_sim``."""
    vector = [c for c in ("v", "t", "w") if c in queries.columns]
    queries, docs = queries.dropna(subset=["q", *vector]), docs.dropna(subset=["d", *vector])
    id_type = {c: ("string" if t == "string" else "bigint") for c, t in [*queries.dtypes, *docs.dtypes] if c in "qd"}
    schema = f"q {id_type['q']}, d {id_type['d']}, sim double"

    def measured(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(vector[0])).alias("cells")).first()
        return row["rows"], (row["cells"] or 0) * 12

    query_rows, query_bytes = measured(queries)
    if query_bytes <= broadcast_bytes:
        pairs = _with_broadcast(docs, queries, min_sim, n, schema, sent="queries")
    else:
        doc_rows, doc_bytes = measured(docs)
        if doc_bytes <= broadcast_bytes:
            if query_rows <= SPREAD_ROWS:
                # a short table often sits in one file; every query still meets all documents in one task
                queries = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism, "q")
            pairs = _with_broadcast(queries, docs, min_sim, n, schema, sent="docs")
        elif doc_bytes <= PIECES * broadcast_bytes:
            if query_rows <= SPREAD_ROWS:
                queries = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism, "q")
            pairs = _with_pieces(queries, docs, min_sim, n, schema, -(-doc_bytes // broadcast_bytes))
        else:
            pairs = _with_blocks(queries, docs, min_sim, n, schema, query_rows, doc_rows)
    # a task keeps its best n per query before anything is shuffled
    return top_per_key(pairs, ["q"], [F.col("sim").desc(), F.col("d").asc()], n)


def _with_broadcast(
    large: DataFrame, small: DataFrame, min_sim: float, n: int, schema: str, sent: str
) -> DataFrame:
    block = small.sparkSession.sparkContext.broadcast(small.toArrow())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = _Postings(block.value) if sent == "docs" and "t" in block.value.column_names else None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            queries, docs = (block.value, own) if sent == "queries" else (own, block.value)
            yield from _best_in(queries, docs, min_sim, n, postings)

    return large.mapInArrow(score, schema)


def _with_pieces(queries: DataFrame, docs: DataFrame, min_sim: float, n: int, schema: str, pieces: int) -> DataFrame:
    """Every task meets all pieces of the documents with its own queries, some at a time. No side is shuffled or repeated; a piece is on an executor once."""
    piece = F.pmod(F.xxhash64("d"), F.lit(pieces))
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(docs.where(piece == i).toArrow()) for i in range(pieces)]

    def got(block) -> Callable[[], tuple[pa.Table, None]]:
        def value() -> tuple[pa.Table, None]:
            table = block.value
            if getattr(block, "_path", None):
                vars(block).pop("_value", None)  # read again for the next queries, so that one piece is held at a time
            return table, None

        return value

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _slabs(batches):
            yield from _best_of(slab, [got(block) for block in sent], min_sim, n)

    return queries.mapInArrow(score, schema)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of at least ``SLAB_ROWS``, but for the last one."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SLAB_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _with_blocks(
    queries: DataFrame, docs: DataFrame, min_sim: float, n: int, schema: str, query_rows: int, doc_rows: int
) -> DataFrame:
    doc_blocks = max(1, -(-doc_rows // DOCS_PER_BLOCK))
    query_blocks = max(1, -(-query_rows // QUERIES_PER_BLOCK))

    def spread(df: DataFrame, key: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        mine = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    left = spread(docs, "d", "_db", doc_blocks, "_qb", query_blocks)
    right = spread(queries, "q", "_qb", query_blocks, "_db", doc_blocks)
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    empty = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]).empty_table()

    def score(doc_part: pa.Table, query_part: pa.Table) -> pa.Table:
        found = list(_best_in(query_part, doc_part, min_sim, n))
        return pa.Table.from_batches(found) if found else empty

    return left.groupBy("_db", "_qb").cogroup(right.groupBy("_db", "_qb")).applyInArrow(score, schema)
