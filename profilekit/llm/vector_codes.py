"""Product codes for vectors: small integer codebooks, and Orchard's search for the nearest entry.

Every entry of a codebook keeps the others sorted by their distance from it. The search holds the best entry so far
and goes through its list; an entry that is nearer takes over with its own list. Entries that were looked at are
marked, and a list ends where its entries lie more than twice as far from the best one as the vector does: by the
triangle inequality none of them can be as near. The search is exact, ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are kept within this limit, so that distances and sums fit 64 bits.
LIMIT = 1 << 24
#: Vectors that are searched at once.
ROWS = 4096


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold neither nulls nor values that are not finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of all components, one row each; shorter vectors end in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the others by rising distance, and their squared distances."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    own = np.eye(len(book), dtype=bool)
    order = np.argsort(np.where(own, -1, apart), axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, axis=1)


def orchard(points: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry; all points take their steps together."""
    order, apart = lists
    # the first guess: the entry whose components have the nearest sum
    sums = book.sum(axis=1)
    by_sum = np.argsort(sums, kind="stable")
    best = by_sum[np.minimum(np.searchsorted(sums[by_sum], points.sum(axis=1)), len(book) - 1)]
    nearest = ((points - book[best]) ** 2).sum(axis=1)
    seen = np.zeros((len(points), len(book)), bool)
    seen[np.arange(len(points)), best] = True
    at = np.zeros(len(points), np.int64)
    open_ = np.arange(len(points))
    while True:
        open_ = open_[at[open_] < order.shape[1]]
        if not len(open_):
            return best, nearest
        # distances are squared: beyond twice the distance is beyond four times its square
        open_ = open_[apart[best[open_], at[open_]] <= 4 * nearest[open_]]
        entry = order[best[open_], at[open_]]
        at[open_] += 1
        fresh = ~seen[open_, entry]
        rows, entry = open_[fresh], entry[fresh]
        seen[rows, entry] = True
        distance = ((points[rows] - book[entry]) ** 2).sum(axis=1)
        better = (distance < nearest[rows]) | ((distance == nearest[rows]) & (entry < best[rows]))
        rows = rows[better]
        best[rows], nearest[rows], at[rows] = entry[better], distance[better], 0


@dataclass
class Codebooks:
    """Entries by part, index and position within the part."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index by row and part, and the squared distances summed over parts."""
        parts, _, size = self.entries.shape
        lists = [neighbour_lists(b) for b in self.entries]
        codes, errors = np.zeros((len(points), parts), np.int64), np.zeros(len(points), np.int64)
        for row in range(0, len(points), ROWS):
            for p in range(parts):
                codes[row : row + ROWS, p], distance = orchard(points[row : row + ROWS, p * size : (p + 1) * size], self.entries[p], lists[p])
                errors[row : row + ROWS] += distance
        return codes, errors


def _improve(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of its parts. Tasks send one sum per part and entry."""
    parts, entries, size = books.entries.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            points = integers(batch.column(0), books.width)
            codes, _ = books.assign(points)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], points[:, p * size : (p + 1) * size])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]),
            **{f"s{i}": pa.array(sums[p, e, i]) for i in range(size)},
        })

    columns = [f"s{i}" for i in range(size)]
    sent = rows.select("_vector").mapInArrow(partial, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in columns))
    out = books.entries.copy()
    # a row per part and entry
    for r in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect():
        out[r.part, r.entry] = [r[c] // r.n for c in columns]
    return Codebooks(out)


def _ready(vectors: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    kind = "array<double>" if dict(vectors.dtypes)[vector] == "array<double>" else "array<float>"
    return vectors.where(usable(F.col(vector))).select(F.col(vector).cast(kind).alias("_vector"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])


def fit(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks that start as the parts of the ``entries`` least keys' vectors and improve for ``rounds`` rounds.

    Unusable vectors (null, or with a component that is null or not finite) are left out; without any others the
    result is None. Vectors of different lengths, or of one that ``parts`` does not divide, count as ending in zeros.
    Equal keys are ordered by their vectors, null keys come last. Integer components beyond ``LIMIT`` count as the limit.
    """
    rows = _ready(vectors, vector, [key])
    width = rows.agg(F.max(F.size("_vector"))).first()[0]
    if width is None:
        return None
    size = max(1, -(-width // parts))
    first = rows.orderBy(F.col("_0").asc_nulls_last(), "_vector").limit(entries).select("_vector").toArrow()
    points = integers(first.column(0), size * parts)
    books = Codebooks(np.stack([points[:, p * size : (p + 1) * size] for p in range(parts)]))
    for _ in range(rounds):
        books = _improve(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: Sequence[str] = ("vec_id", "label"), vector: str = "embedding") -> DataFrame:
    """The columns ``keep`` of all usable vectors, ``code`` (a byte per part) and ``error`` (squared distance, summed)."""
    rows = _ready(vectors, vector, keep)
    schema = rows.drop("_vector").schema.add("code", "binary").add("error", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.assign(integers(batch.column(0), books.width))
            raw = [c.tobytes() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[1:], arrow)), pa.array(raw, pa.binary()), pa.array(errors)], schema=arrow)

    return rows.mapInArrow(run, schema).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "code", "error")


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error (nulls are one label) and the codebooks' checksum."""
    books = fit(vectors)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = materialize(encode(vectors, books), "codes")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("vec_id").cast("long"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
